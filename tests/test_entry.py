import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_operators(tmp_path):
    """The entry module and the library import with that subpackage away."""
    import shutil

    repo = __file__.rsplit("/tests/", 1)[0]
    shutil.copytree(f"{repo}/folia", tmp_path / "folia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.llm is None and 'pipeline' not in e.queries() and len(e.queries()) > 20"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
