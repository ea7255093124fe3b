"""Memory of Python workers: what an operator has kept is back with the system when another one begins."""

import subprocess
import sys

from conftest import ROOT

PLAIN = """
import re
from pathlib import Path
import numpy as np
import pyarrow as pa
from kestrel.llm import common
mb = lambda: sum(map(int, re.findall(r"Private_Dirty: +(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
def full():
    kept = [np.ones(12_500) for _ in range(1_200)]       # 100 KB each: small enough for the heap
    return kept, np.ones(12_000)                         # the last piece keeps the heap's end in use
before = mb()
kept, last = full()
common.hold("one", kept.clear)
assert mb() > before + 100
common.hold("two", lambda: None)
assert mb() < before + 40, mb() - before
kept, last2 = full()
kept.clear()
for b in common.slices([pa.record_batch({"x": [1], "text": ["a"]})]):
    pass
assert mb() < before + 40, mb() - before
"""


def test_workers_give_memory_back():
    done = subprocess.run([sys.executable, "-c", PLAIN], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr

