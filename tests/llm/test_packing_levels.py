"""A merged group hands on a bounded number of open windows and keeps every piece."""

import pyarrow as pa

from wardlight.llm import packing


def test_open_windows_of_a_merged_group_are_bounded():
    # 40 partitions of 64 windows each, no two of which fit together
    rows = [(i, 0, 600 + i % 300, 7, 900, (i // 64 << 32) | i % 64, 0, i // 64, True) for i in range(40 * 64)]
    table = pa.Table.from_batches([packing._batch(rows)])
    merged = packing._merge_group(1, False, 1024)(table).to_pylist()
    assert sorted((r["doc_id"], r["length"]) for r in merged) == sorted((r[0], r[2]) for r in rows)
    opened = [r for r in merged if r["open"]]
    assert len({r["sequence_id"] for r in opened}) == packing.OPEN
    # the emptiest windows are the ones that wait
    assert max(r["length"] for r in opened) <= min(r["length"] for r in merged if not r["open"])
    assert not any(r["open"] for r in packing._merge_group(1, True, 1024)(table).to_pylist())
