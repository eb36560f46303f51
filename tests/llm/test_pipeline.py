import random

import corpus_pipeline as cp
from lockstep.llm import entries
from test_passages import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(rng):
    words = [f"w{a}{b}" for a in "abcdefg" for b in "hijklmn"]

    def prose(n):
        return " ".join(rng.choices(words, k=n)) + "."

    rows, labels, passage = [], [], "é".join(rng.choices(words, k=120))  # é and è share their first byte
    for i in range(400):
        text = prose(rng.choice([30, 90]))
        good, toxic = i % 5 != 0, i % 7 == 0
        if toxic:
            text = text.replace(" ", " grumblefish ", 3)
        if not good:
            text = "%%% ".join(text.split()) + "%%%"
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000 + i, rows[i + 1][1]) for i in range(0, 40, 5)] + [(2000 + i, prose(60) + passage + "éèêë"[i] + prose(60)) for i in range(4)]
    rows += [(3000, None), (3001, ""), (3002, ""), (None, prose(40)), (3003, rows[2][1]), (3003, rows[2][1])]
    return [(i, t, "en", None, len(t or ""), "x") for i, t in rows], labels


def test_stages_against_plain_python(spark, tmp_path):
    rows, labels = corpus(random.Random(7))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        out.append([r.asDict() for r in docs.collect()])
    good = {i for i, q, _ in labels if q}
    toxic = {i for i, _, t in labels if t}
    ids = [{r["doc_id"] for r in o} for o in out]
    labelled = {i for i, _, _ in labels}
    assert len((ids[0] & labelled) ^ good) <= 4 and {1000, 2000, None} <= ids[0]
    assert len((ids[1] & labelled) ^ (ids[0] & good - toxic)) <= 4 and {1000, 2000, None} <= ids[1]
    # near copies: here only copies are alike, so one row of every text stays, with its smallest id
    first = {}
    for r in out[1]:
        t = r["text"] or ""
        first[t] = min(first.get(t, 10**9), 10**8 if r["doc_id"] is None else r["doc_id"])
    assert sorted((r["text"] or "", 10**8 if r["doc_id"] is None else r["doc_id"]) for r in out[2]) == sorted(first.items())
    want = brute([r["text"] for r in out[2]], cp.PASSAGE_BYTES)
    cut = {r["doc_id"]: r for r in out[3]}
    assert len(cut) == len(out[2]) and any(w[1] for w in want)
    for r, w in zip(out[2], want, strict=True):
        left = cut[r["doc_id"]]
        assert left["n_chars"] == len(left["text"]) and (left["text"] == (r["text"] or "")) == (w[1] == 0)
        assert w[0] - w[1] - 6 <= len(left["text"].encode()) <= w[0] - w[1]
    pieces = entries.packed(spark.read.parquet(f"{tmp_path}/3")).toPandas()
    assert len(out[4]) == len(pieces) and {r["doc_id"] for r in out[4]} == ids[3]
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in out[4]) == sorted((("None" if i != i else str(int(i))), p, c) for i, p, c in zip(pieces.doc_id, pieces.piece, pieces.ids_crc32, strict=True))


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
