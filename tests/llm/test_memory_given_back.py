"""Python workers return what they have freed, so that their leftovers don't add up within an executor."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import re, sys
import pyarrow as pa
from lexiphyte.llm import bpe, token_counts

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

class Table:
    def select(self, *a): return self
    def groupBy(self, *a): return self
    def agg(self, *a): return self
    def mapInArrow(self, run, schema):
        runs.append(run)
        return self

runs = []
token_counts.F = bpe.F = type("F", (), {"col": lambda *a: F, "sum": lambda *a: F})
F = type("C", (), {"alias": lambda self, *a: self})()
WHICH
run = runs[0]
list(run(iter([])))
least = held()
texts = lambda: (pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k}x{i}y{j}" for j in range(60)) for i in range(1_000)])], ["text"]) for k in range(4))
for batch in run(texts()):
    pass
del batch
print(held() - least)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's own figures")
@pytest.mark.parametrize("which", ["token_counts.vocabulary(Table(), PATH)"])
def test_counting_leaves_little_behind(which):
    code = RUN.replace("WHICH", which).replace("PATH", repr(public_tokenizers.path("word_bpe_49k.json")))
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 10
