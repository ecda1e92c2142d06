"""Task functions have to run in a process that has loaded nothing but what they bring along."""

from __future__ import annotations

import subprocess
import sys

import pyarrow as pa
from pyspark import cloudpickle

from tarnwheel.llm import substrings

RUN = "import pickle, sys; f, x = pickle.load(sys.stdin.buffer); print(f(x).num_rows)"


def test_repeated_anchors_in_a_bare_process():
    some = [b"\1\0\0\0\0\0\0\0"] * 2
    table = pa.table({"known": [False, False], "anchors": some, "texts": [some[0], b"\2\0\0\0\0\0\0\0"]})
    out = subprocess.run(
        [sys.executable, "-c", RUN], input=cloudpickle.dumps((substrings.repeated_anchors, table)), capture_output=True, timeout=60
    )
    assert out.stdout.strip() == b"2", out.stderr.decode()
