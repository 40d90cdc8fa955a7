"""The package on executors that do not have it, and the command line."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
RUN = """
import sys
sys.path.insert(0, {repo!r})
from tideline.session import local_session, ship
from tideline.queries.models import knn_analog
spark = local_session(2, 2, "ship")
ship(spark)
ship(spark)
assert knn_analog(spark, {sf!r}).count() > 0
print("shipped")
"""


def test_functions_run_from_another_folder(tmp_path, sf):
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=str(REPO), sf=sf)], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "shipped" in done.stdout, done.stderr[-2000:]


def test_command_line(capsys):
    from tideline.cli import main

    assert main(["list"]) == 0
    names = capsys.readouterr().out.split()
    assert "policy_grid" in names and "p3_found" in names
    assert main(["run", "nothing", "--data", "."]) == 2
