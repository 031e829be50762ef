"""The hashing embedder in arrays equals its definition, and no text is embedded twice."""

import random
import zlib

import numpy as np

from quillspan.operators import embed, evaluate


def slow(text):
    row, padded = np.zeros(64, np.float32), f" {(text or '').lower()} "
    for n in (3, 4) if padded.strip() else ():
        for i in range(len(padded) - n + 1):
            h = zlib.crc32(padded[i : i + n].encode())
            row[(h >> 1) % 64] += 1 if h & 1 else -1
    norm = float(np.linalg.norm(row))
    return row / norm if norm else row


def test_hashing_vectors(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcAB é漢😀İß\n") for _ in range(rnd.randint(0, 12))) for _ in range(500)] + [None, "", " ", "ab" * 90]
    monkeypatch.setattr(embed, "STEP", 100)
    assert (embed.hashing_vectors(texts) == np.stack([slow(t) for t in texts])).all()


def test_encoding_invariance_embeds_each_text_once(spark, tmp_path):
    def load():
        def model(texts):
            with open(f"{tmp_path}/seen", "a") as f:
                f.writelines("one\n" for _ in texts)
            return np.ones((len(texts), 2), np.float32)

        return model

    notes = spark.createDataFrame([(1, "plain"), (2, "café\nau lait"), (3, "")], "note_id int, text string").coalesce(1)
    got = evaluate.encoding_invariance(notes, load=load).collect()
    assert sorted((r.note_id, r.variant) for r in got) == [(i, v) for i in "12" for v in ("bom", "crlf", "nfd")] and all(r.ok for r in got)
    assert len(open(f"{tmp_path}/seen").readlines()) == 2


def test_encodings_are_cleaned_in_small_batches(spark):
    """One pass of bounded batches cleans all forms; before, two functions over columns held a batch of each form."""
    import pyarrow as pa

    from quillspan.operators import chunk

    texts = [f"é{i}\n" * 30_000 for i in range(60)] + [None, "﻿a\r\nb"]
    batch = pa.RecordBatch.from_pydict({"note_id": [str(i) for i in range(62)], "text": texts})
    made = list(evaluate._cleaned(iter([batch])))
    rows = [r for b in made for r in zip(*(c.to_pylist() for c in b.columns))]
    assert [n.split("\0")[0] for n, _ in rows] == [str(i) for i in range(60)] + ["61", "61"]
    assert rows[0] == ("0\0base,crlf,bom,nfd", texts[0]) and rows[-2:] == [("61\0base,crlf,nfd", "a\nb"), ("61\0bom", "﻿a\nb")]
    assert len(made) > 1 and all(sum(map(len, b.column(1).to_pylist())) <= chunk.SEND + len(texts[0]) for b in made)
    plan = evaluate.encoding_invariance(spark.createDataFrame([(1, "é")], "note_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
