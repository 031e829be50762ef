"""What a task frees goes back to the system, though its Python worker lives on."""

import subprocess
import sys

PROBE = """
import re
import pyarrow as pa
from quillspan.llm.common import released

def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

def run(batches):
    for batch in batches:
        many = [b"%d" % k * 200 for k in range(150_000)]
        pins.append(b"%d" % len(many) * 200)  # freed memory below it doesn't go by itself
        del many
        yield batch

pins, before = [], held()
list(run(iter([pa.record_batch({"x": [1]})])))
plain = held() - before
list(released(run)(iter([pa.record_batch({"x": [1]})])))
print(plain, held() - before)
"""


def test_a_task_gives_its_memory_back():
    plain, tidy = map(int, subprocess.run([sys.executable, "-c", PROBE], capture_output=True, text=True, check=True, timeout=60).stdout.split())
    assert plain > 100
    assert tidy < plain / 2
