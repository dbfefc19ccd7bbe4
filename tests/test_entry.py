"""The driver contract without parts of its surroundings."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys, warnings
warnings.simplefilter("ignore")
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
keys = set(entry.queries())
assert "next_week_top10" in keys and "item_gram" in keys, keys
assert not any(k.startswith("op1_") or k == "pipeline" for k in keys), keys
assert set(entry.oracle_sql()) <= keys
"""


def run_without(missing):
    subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, check=True)


def test_queries_without_a_library():
    run_without("ahocorasick")


def test_queries_without_the_corpus_pipeline():
    run_without("corpus_pipeline")
