"""What tasks hold: memory and caches of worker processes, batches that leave a task."""

import numpy as np
import pyarrow as pa

from ragloom.llm import pitman_yor, wordids
from ragloom.llm.common import give_back, tidied, tidied_group
from ragloom.llm.packing import byte_bpe


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_leaves_the_process():
    blocks = [np.ones(12_000) for _ in range(2000)]  # some 190 MB in blocks that malloc keeps
    pins = [b for b in blocks[::50]]
    high = resident()
    del blocks
    give_back()
    assert high - resident() > 120e6
    assert len(pins) == 40


def test_tasks_empty_the_caches_of_other_operators():
    wordids.batch_encoder(byte_bpe(), 1 << 20)
    assert list(tidied(iter, (wordids.batch_encoder,))(iter([1, 2]))) == [1, 2]
    assert wordids.batch_encoder.cache_info().currsize == 1
    assert list(tidied(iter)(iter([1, 2]))) == [1, 2]
    assert wordids.batch_encoder.cache_info().currsize == 0
    assert tidied_group(lambda rows: rows.num_rows)(pa.table({"a": [1, 2]})) == 2


def test_counted_parts_leave_a_task_in_small_batches(spark):
    """The same parts whether a chunk leaves at once or part by part."""
    words = [f"w{i % 97}x{i % 13}" for i in range(4000)]
    docs = spark.createDataFrame([(i, i % 7 == 2, bytearray(" ".join(words[i * 40 : i * 40 + 40]).encode())) for i in range(100)], "id long, held boolean, text binary").coalesce(1)

    def parts(**how):
        params = pitman_yor.PitmanYorParams(part_tokens=300, chunk_tokens=1500, hot_share=0.01, **how)
        stored, hot = pitman_yor.count(docs, params)
        return sorted(stored.collect(), key=lambda r: (r["part"] is None, r["part"] or 0, r["base"] or 0)), hot.tolist()

    assert parts(send_bytes=1) == parts(send_bytes=1 << 30)
