"""The entry without the training-text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "postsift"), tmp_path / "postsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = (
        "import __spark_entry__ as e; from postsift.session import local_session; s = local_session(2, 'entry')\n"
        "q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')]\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
        "print([q[n](s, '/root/testdata/sf0.001').count() for n in ('a2_status_counts', 'd1_dedup_url', 'f9_score_label')])")
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
