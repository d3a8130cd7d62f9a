"""The entry file with and without the folders for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
TELL = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(s) <= set(q))"


def _told(folder):
    return subprocess.run([sys.executable, "-c", TELL], cwd=folder, capture_output=True, text=True, timeout=120)


def _copy(to, *without):
    to.mkdir()
    for file in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if file not in without and (ROOT / file).exists():
            shutil.copy(ROOT / file, to / file)
    shutil.copytree(ROOT / "tilegrid", to / "tilegrid", ignore=shutil.ignore_patterns("__pycache__", *without))
    return to


def test_entry_without_the_training_data_folders(tmp_path):
    for name, without in (("one", ("llm",)), ("both", ("llm", "corpus_pipeline.py"))):
        done = _told(_copy(tmp_path / name, *without))
        assert done.returncode == 0, done.stderr
        n, own, fits = done.stdout.split()
        assert int(n) >= 55 and own == "0" and fits == "True"


def test_broken_modules_are_told(tmp_path):
    folder = _copy(tmp_path / "broken", "llm")
    (folder / "tilegrid" / "llm").mkdir()
    (folder / "tilegrid" / "llm" / "__init__.py").write_text("")
    (folder / "tilegrid" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    done = _told(folder)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
