"""The entry module: names, and that it stands without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(tmp_path):
    """A missing corpus part is left out; a corpus part that is there and broken is an error."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    (tmp_path / "rillet").mkdir()
    for p in (ROOT / "rillet").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "rillet" / p.name).symlink_to(p)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), e.corpus)"], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    out = run()
    assert out.returncode == 0 and out.stdout.split()[1] == "None" and int(out.stdout.split()[0]) > 100, out.stderr
    if (ROOT / "corpus_pipeline.py").exists():  # the pipeline is there, its operators are not
        (tmp_path / "corpus_pipeline.py").write_text((ROOT / "corpus_pipeline.py").read_text())
        out = run()
        assert out.returncode == 0 and out.stdout.split()[1] == "None", out.stderr
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    assert run().returncode != 0
