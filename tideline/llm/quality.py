"""Per-document text statistics and a verdict on whether a text is natural prose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType

# The most frequent function words of some languages.
COMMON = {
    "ar": "في من على أن إلى هذا التي",
    "de": "der die das und ist nicht ein zu den von mit auf",
    "en": "the be to of and that have with is are was in it for on not as at by this but from or they we you if when which an has had no a so",
    "es": "el los que en y del por con una no se para",
    "fr": "le la les de et est que des une dans pas pour",
    "it": "il di che non per un della sono gli anche",
    "kk": "және бұл мен үшін бір деп",
    "nl": "het een van en dat niet op te zijn",
    "pl": "nie na jest się do że jak ale",
    "pt": "o os do da em um não uma com mais",
    "ru": "и в не на что с то это как а но из за если или у к о от до для же бы мы они его их чтобы когда только уже по",
    "tr": "ve bir için da de çok olan ile daha",
    "uk": "і та що не на як але є",
    "uz": "va bu bilan uchun ham lekin chunki agar haqida emas edi yoki bir keyin nima yana hali juda deb shu kerak hech men siz ular har",
}
# Thresholds of published rules. Lines of fewer than five words are dropped by one web corpus' cleaning; mean word
# length, symbols a word, share of words with a letter and two common words in a text of fifty words come from another's.
LINE_WORDS, MEAN_LENGTH, SYMBOLS, LETTERED, COMMON_WORDS, COMMON_FROM = 5, (3.0, 10.0), 0.1, 0.8, 2, 50
# Limits of our own: least share of tokens written like words, most capitalised words, words to a comma, words from which a marked line is a sentence.
SHAPED, CAPITALS, COMMAS, LONG_ITEM = 0.9, 0.4, 3, 14
REASONS = ("few_words", "word_length", "symbols", "lettered_words", "common_words", "bullets", "word_shape", "capitals", "commas")

_ASIDE = r" ?\([^()\p{Ll}]+\)"  # bracketed figures and codes inside a sentence
_MARK = r"^\s*(?:[-*+•▪◦‣·→⇒►●○■□✓✔–]|\(?\d{1,4}[.)]|\(?\p{L}[.)]|\[[ xXхХ]?\]|[ivxIVX]{1,5}[.)])\s+\S"
# A word in lower case, with a capital first or all in capitals, of any script; a number; a code of capitals and digits.
_SHAPE = r"(?:^| )[\"'«»“”„(\[>§#*_—–-]*(?:(?:\p{L}?[\p{Ll}\p{Lo}\p{M}]+|\p{Lu}+\d*)(?:['’‘ʻʼ-]\p{L}*)*|[+-]?\d[\d.,:%]*)[\"'»”’)\].,;:!?…%]*(?: |$)"

_SPACE, _NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
_COMMON = " (?:" + "|".join(sorted({w for words in COMMON.values() for w in words.split()})) + ") "
_HALF = 0.5  # share of a text's characters from which it is no prose


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _matches(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _length(lines: pa.Array) -> np.ndarray:
    return pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def _counts(lines: pa.Array) -> dict[str, np.ndarray]:
    """What is counted of each line's characters, words and tokens."""
    spaces = pc.count_substring(lines, " ").to_numpy(zero_copy_only=False).astype(np.int64)
    spread = pc.replace_substring_regex(pc.utf8_lower(lines), r"[^\p{L}\p{M}'’‘ʻʼ-]+", "  ")
    spread = pc.binary_join_element_wise(_SPACE, pc.utf8_trim_whitespace(spread), _SPACE, _NOTHING)  # " word  word "
    words = np.where(_length(spread) > 2, pc.count_substring(spread, "  ").to_numpy(zero_copy_only=False).astype(np.int64) + 1, 0)
    return {
        "solid": _length(lines) - spaces, "tokens": spaces + 1, "words": words, "letters": np.maximum(_length(spread) - 2 * np.maximum(words, 1), 0),
        "shaped": _count(pc.replace_substring(lines, " ", "  "), _SHAPE), "capitals": _count(lines, r"(?:^|[^\p{L}\p{M}'’‘ʻʼ-])\p{Lu}"), "common": _count(spread, _COMMON),
        "commas": _count(lines, r"[,;|/\t]"),
    }


def _wrapped(block: np.ndarray, length: np.ndarray, head: np.ndarray, marked: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """For each line, whether its block (run of lines between blank ones) is a wrapped paragraph.

    That takes two lines or more, none marked as an item; nine tenths of them but the last so long that the next line's
    first word (of length `head`) would not have fitted into the longest line; and, under 45 characters, a sentence's end.
    """
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, len(block)])
    longest = np.maximum.reduceat(length, starts)
    last = np.zeros(len(block), bool)
    last[starts + sizes - 1] = True
    tight = (length + 1 + np.r_[head[1:], 0] > np.repeat(longest, sizes)) | last
    count = lambda v: np.add.reduceat(v.astype(np.int64), starts)
    good = (count(tight) >= 0.9 * sizes) & (sizes >= 2) & (longest >= 28) & (count(marked) == 0) & ((longest >= 45) | ended[starts + sizes - 1])
    return np.repeat(good, sizes)


def _failed(s: dict[str, np.ndarray]) -> np.ndarray:
    """For each rule of REASONS, the segments that fail it, given their sums."""
    words, tokens = np.maximum(s["words"], 1), np.maximum(s["tokens"], 1)
    mean = s["letters"] / words
    return np.stack(
        [
            s["words"] < LINE_WORDS,
            (mean < MEAN_LENGTH[0]) | (mean > MEAN_LENGTH[1]),
            s["symbols"] > SYMBOLS * words,
            s["words"] < LETTERED * tokens,
            s["common"] < np.where(s["words"] >= COMMON_FROM, COMMON_WORDS, COMMON_WORDS / 2),
            (s["mark"] > 0) & (s["words"] < np.where(s["dash"] > 0, LINE_WORDS, LONG_ITEM)),
            s["shaped"] < SHAPED * tokens,
            (s["capitals"] > CAPITALS * words) & (s["common"] < (1 - CAPITALS) / 2 * words),
            s["commas"] >= np.maximum(COMMAS, words / COMMAS),
        ]
    )


def line_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of every document, added up over its lines and running segments; whole texts, vectorised over all lines of the batch."""
    n_docs = len(texts)
    text = pc.fill_null(texts.cast(pa.large_string()), "")
    unified = pc.replace_substring_regex(text, r"\r\n?|\x{2028}|\x{85}", "\n")
    split = pc.split_pattern(unified, "\n")
    lines = split.flatten() if hasattr(split, "flatten") else pc.list_flatten(split)
    doc = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.utf8_trim_whitespace(pc.replace_substring_regex(lines, r"[\p{Z}\t\v\f]{2,}|[\t\v\f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " "))
    length = _length(lines)
    full = length > 0
    gap = np.cumsum(~full)  # lines between the same blank lines share a value
    keep = pa.array(full)
    lines, doc, gap, length = lines.filter(keep), doc[full], gap[full], length[full]
    zero = np.zeros(n_docs)
    if not len(lines):
        return {k: zero.copy() for k in ("words", "word_chars", "tokens", "symbols", "lines", "ended", "bullets", "ellipses", "common", "solid", "bad")} | {"fails": np.zeros((len(REASONS), n_docs))}
    block = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (gap[1:] != gap[:-1])])

    counts = _counts(lines)
    symbols = _count(lines, r"[#*=_~^|<>{}\\$@+]|\.\.\.|…")
    bullets = _matches(lines, _MARK)
    dash = _matches(lines, r"^\s*[–—-]\s")
    ended = _matches(lines, r"[.!?…][\"'»”)\]]*$")
    ellipses = _matches(lines, r"(?:\.\.\.|…)$")
    sums = lambda v, by, n: np.bincount(by, weights=v, minlength=n)

    # Whether a sentence runs is judged without its asides; a line that has no word besides them doesn't run.
    aside = _matches(lines, _ASIDE)
    plain = {k: v.copy() for k, v in counts.items()}
    for k, v in _counts(pc.utf8_trim_whitespace(pc.replace_substring_regex(lines.filter(pa.array(aside)), _ASIDE, ""))).items():
        plain[k][aside] = v
    bare = aside & (plain["words"] == 0)

    # Segments: a wrapped paragraph as one, every other line by itself.
    head = _length(pc.replace_substring_regex(lines, r" .*$", ""))
    joined = _wrapped(block, length, head, bullets & ~dash, ended)
    seg = np.cumsum(np.r_[False, (block[1:] != block[:-1]) | ~(joined[1:] & joined[:-1])])
    m = int(seg[-1]) + 1
    s = {k: sums(v, seg, m) for k, v in (plain | {"mark": bullets, "dash": dash, "symbols": np.where(aside, 0, symbols)}).items()}
    fails = _failed(s)
    failed = fails.any(0)[seg] | bare
    bad = np.where(failed, counts["solid"], 0)
    add = lambda v: sums(v, doc, n_docs)
    return {
        "words": add(counts["words"]), "word_chars": add(counts["letters"]), "tokens": add(counts["tokens"]), "symbols": add(symbols), "lines": add(np.ones(len(doc))),
        "ended": add(ended), "bullets": add(bullets), "ellipses": add(ellipses), "common": add(counts["common"]), "solid": add(counts["solid"]), "bad": add(bad),
        "fails": np.stack([sums(np.where(f[seg] | (bare & (k == 0)), counts["solid"], 0), doc, n_docs) for k, f in enumerate(fails)]),
    }


def judge(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Shares of the statistics and, for each rule, the documents it counts against."""
    per = lambda a, b: x[a] / np.maximum(x[b], 1)
    out = {"mean_word_length": per("word_chars", "words"), "symbol_share": per("symbols", "words"), "punctuated_line_share": per("ended", "lines"), "common_word_share": per("common", "words"), "bullet_line_share": per("bullets", "lines"), "unprose_share": per("bad", "solid")}
    out["fails"] = (out["unprose_share"] > _HALF) & (x["fails"] > 0)
    return out


def text_quality(documents: DataFrame, *, item: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, word_count, mean_word_length, symbol_share, punctuated_line_share, common_word_share, bullet_line_share, unprose_share, reasons, is_prose.

    Statistics are counted by vectorised patterns over all lines of an Arrow batch. Fixed-threshold rules are applied to
    every segment of a text, a wrapped paragraph or else a line, and each segment that fails any counts as list, table or
    junk. Published thresholds: at least five words ('few_words'), mean word length 3-10 ('word_length'), at most 0.1
    symbols a word ('symbols'), 80 % of tokens words with a letter ('lettered_words'), two common words in fifty or more,
    one in fewer ('common_words'), no line that begins with a bullet or number ('bullets', under 14 words; under five after a dash, which opens speech too). Beside them: 90 %
    of tokens written like words, numbers or codes of any script ('word_shape'); at most 40 % capitalised words unless 30 % are
    common ones ('capitals'); fewer than one separator in three words ('commas'). A document is prose unless more than half of
    its characters other than blanks lie in failing segments; then `reasons` names every rule that failed any of them, else it is
    empty. Segments are judged without bracketed figures and codes, which count in all else; a line with nothing beside
    them is a row ('few_words').

    Common words are those of fourteen languages in Latin, Cyrillic and Arabic letters; scripts written without blanks between words
    are not told from junk.

    Documents are independent: no row moves between tasks. Defined cases: null, empty and blank texts have zero
    statistics and count as prose without reasons, as nothing in them is not; texts of any length are read whole; repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    schema = documents.select(item).schema
    for name, kind in (("word_count", "long"), ("mean_word_length", "double"), ("symbol_share", "double"), ("punctuated_line_share", "double"), ("common_word_share", "double"), ("bullet_line_share", "double"), ("unprose_share", "double"), ("reasons", ArrayType(StringType())), ("is_prose", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = line_statistics(part.column(1))
                y = judge(x)
                fails = y["fails"].T
                names = pa.DictionaryArray.from_arrays(pa.array(np.nonzero(fails)[1], pa.int32()), pa.array(REASONS)).dictionary_decode()
                reasons = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(fails.sum(1))], pa.int32()), names)
                shares = [pa.array(y[k]) for k in ("mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "bullet_line_share", "unprose_share")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x["words"].astype(np.int64)), *shares, reasons, pa.array(~fails.any(1))], names=schema.names)

    return documents.select(item, text).mapInArrow(run, schema)
