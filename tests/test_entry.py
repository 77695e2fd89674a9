import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """Without the subpackage, with and without the pipeline beside it, all other queries are still listed."""
    shutil.copytree(ROOT / "locarium", tmp_path / "locarium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and 'pipeline' not in q and set(s) <= set(q) and not [k for k in q if k.startswith('op')]"
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
        (tmp_path / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
