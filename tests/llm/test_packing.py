import io

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratabranch.llm import packing

ROWS = [(1, "Hello world, hello again!"), (2, None), (3, ""), (4, "long text " * 3000), (None, "no id"), (5, "<|endoftext|> is text here"), (6, "tab\t\nnew  line ünïcode 日本"), (6, "the same id, other text")]


def expected(rows):
    """(doc_id, ids) of every row."""
    t = packing.tokenizer(packing.VOCABULARY)
    return sorted(((d, t.coder.encode_ordinary(x or "") + [packing.END]) for d, x in rows), key=str)


def unpacked(packed):
    return sorted(((r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in packing.unpack(packed).collect()), key=str)


def test_round_trip(spark):
    """Null and repeated ids too: each row comes back by itself."""
    rows = ROWS * 2
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS row"), width=64)
    back = unpacked(out)
    assert back == expected(rows)
    t = packing.tokenizer(packing.VOCABULARY)
    assert sorted((t.coder.decode(ids[:-1]) for _, ids in back)) == sorted(x or "" for _, x in rows)


def test_small_tasks_leave_no_more_room(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fill = {}
    for tasks in (1, 40):
        rows = packing.pack(docs.repartition(tasks)).select("n_tokens", "part", "row").collect()
        assert len({(r.part, r.row) for r in rows}) == len(rows)
        fill[tasks] = sum(r.n_tokens for r in rows) / (packing.WIDTH * len(rows))
    assert fill[40] > 0.99 * fill[1]


def test_small_buffers(spark, sf_dir, monkeypatch):
    """Rows with room wait for the next buffer, and nothing is lost."""
    monkeypatch.setattr(packing, "BUFFER_IDS", 3000)
    docs = [(k, " ".join(f"w{j}" for j in range(k % 70))) for k in range(400)]
    buffer, got = packing.Buffer(0, 128, 2), []
    for k, text in docs:
        ids = packing.tokenizer(packing.VOCABULARY).ids(text)[:256]
        buffer.add((k, k, 0, ids)) if ids else None
        if buffer.held >= 6000:
            got += [r for b in buffer.flush() for r in b.to_pylist()]
    tail = [r for b in buffer.flush(last=True, hand_on=True) for r in b.to_pylist()]
    assert not any(r["left_open"] for r in got) and {r["row"] for r in got + tail} == set(range(len(got + tail)))
    best = packing.best_fit([min(128, len(packing.tokenizer(packing.VOCABULARY).ids(text)) // 2) for _, text in docs if text], 128)
    assert len(got + tail) <= 1.06 * len(best)  # not much worse than all at once
    assert sorted(k for r in got + tail for k in r["doc_keys"]) == [k for k, text in docs if text]


def test_matrices_are_written(spark, tmp_path):
    packed = packing.pack(spark.createDataFrame(ROWS, "doc_id long, text string"), width=128)
    files = packing.write_matrices(packed, str(tmp_path / "out"), 128, rows=7).collect()
    ids = [np.load(f.path) for f in files if f.path.endswith(".ids.npy")]
    rows = packed.collect()
    assert sorted(x.tobytes() for m in ids for x in m) == sorted(bytes(r.input_ids) for r in rows)
    assert sum(len(np.load(f.path)) - 1 for f in files if ".cu_seqlens." in f.path) == sum(len(r.doc_ids) for r in rows)
    for f in files:
        assert f.bytes == (tmp_path / "out" / f.path.rsplit("/", 1)[1]).stat().st_size
    assert len(list((tmp_path / "out").iterdir())) == len(files)  # nothing half-written is left
    assert packing.write_matrices(packed.limit(0), str(tmp_path / "none"), 128).count() == 0


def test_rows_are_well_formed(spark):
    out = packing.pack(spark.createDataFrame(ROWS, "doc_id long, text string"), width=128).collect()
    assert len({(r.part, r.row) for r in out}) == len(out)
    total = 0
    for r in out:
        assert len(r.input_ids) == 2 * 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_offsets) == len(r.position_resets)
        assert not any(np.frombuffer(r.input_ids, "<u2")[r.n_tokens :])
        total += r.n_tokens
    t = packing.tokenizer(packing.VOCABULARY)
    assert total == sum(len(t.coder.encode_ordinary(x or "")) + 1 for _, x in ROWS)
    assert {d for r in out for d in r.doc_ids} == {d for d, _ in ROWS}


def test_blocks_hold_the_matrix(spark):
    out = packing.pack(spark.createDataFrame(ROWS, "doc_id long, text string"), width=128)
    blocks = packing.matrix_blocks(out, 128, rows=7).collect()
    assert sum(b.rows for b in blocks) == out.count()
    for b in blocks:
        ids, positions, ends = (np.load(io.BytesIO(x)) for x in (b.ids, b.positions, b.cu_seqlens))
        assert ids.shape == positions.shape == (b.rows, 128) and (np.diff(ends) >= 0).all()


def test_documents_all_there(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    assert unpacked(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == expected(list(zip(t["doc_id"], t["text"])))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing(lengths):
    width = 40
    rows = packing.best_fit(lengths, width)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    # The same rule by looking at every open row.
    room, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(room)) if room[r] >= lengths[i]]
        if fits:
            least = min(room[r] for r in fits)
            k = next(r for r in fits if room[r] == least)
        else:
            room.append(width)
            k = len(room) - 1
        room[k] -= lengths[i]
        want.append(room[k])
    assert sorted(width - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_too_long_for_a_row_is_a_mistake():
    with pytest.raises(ValueError):
        packing.best_fit([50], 40)
