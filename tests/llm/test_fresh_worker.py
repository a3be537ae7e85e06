"""Helpers of tasks in a Python process that has run nothing before, as a new worker's."""

import io
import subprocess
import sys

import pyarrow as pa
import pytest

# the batch comes as bytes, as in a task: making its arrays would load what is missing
VERIFY = """
import pyarrow as pa
from boxloom.llm.jaccard import _verify
batch = pa.ipc.open_stream(bytes.fromhex("{data}")).read_next_batch()
print(_verify(batch, 3, 90).column("linked").to_pylist())
"""
COMPUTE = "import sys, boxloom.llm.{module}; print('pyarrow.compute' in sys.modules)"


def fresh(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip()


def test_pairs_are_verified_by_a_new_worker():
    texts = ["a b c d e", "a b c d e", "a b c d f"]
    batch = pa.record_batch([[1, 2], [2, 3], texts[:2], texts[1:]], ["a", "b", "text_a", "text_b"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    assert fresh(VERIFY.format(data=sink.getvalue().hex())) == "[True, False]"


@pytest.mark.parametrize("module", ["jaccard", "classifier"])
def test_modules_load_what_they_compute_with(module):
    assert fresh(COMPUTE.format(module=module)) == "True"
