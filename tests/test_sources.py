"""Folders, encodings, models, streams and the command line."""

import hashlib
import os

import numpy as np
import pytest

from passagework.sources import embed, files, synthetic
from passagework.streaming import incremental, progress

FRENCH = "Le café était fermé, où êtes-vous allé à Noël ?"
RUSSIAN = "Съешь ещё этих мягких французских булок, да выпей чаю"
ARABIC = "مرحبا بالعالم هذه جملة عربية قصيرة"


@pytest.mark.parametrize(
    ("data", "text"),
    [
        (b"\xef\xbb\xbfabc", "abc"),
        ("abc é".encode("utf-16"), "abc é"),
        (FRENCH.encode("utf-16-le"), FRENCH),
        (FRENCH.encode("utf-16-be"), FRENCH),
        (FRENCH.encode(), FRENCH),
        (FRENCH.encode("cp1252"), FRENCH),
        (RUSSIAN.encode("cp1251"), RUSSIAN),
        (ARABIC.encode("cp1256"), ARABIC),
        (b"", ""),
    ],
)
def test_decode(data, text):
    assert files.decode(data) == text


def test_decoded_texts_equal_those_encoded(spark, tmp_path):
    from passagework.plans.queries import load

    texts = ["Anaieux éé èçou éç.", "una " * 20 + "óí. " * 60, "The thing that on èê, le paeu reai.", "Équereç treêê avec. êieroi èç " + "èèé " * 60, "日本語の長い文章です。" * 5, "один два три " * 4, "plain words only, as they are", "don’t – “quoted” words and more words"]
    rows = [(3 * i + r, t) for i, t in enumerate(texts) for r in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hash for r in load()[0]["decode_text"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_decode_takes_any_bytes():
    r = np.random.default_rng(1)
    for _ in range(500):
        assert isinstance(files.decode(r.bytes(int(r.integers(0, 80)))), str)


def test_scan_and_read(spark, tmp_path):
    for name, data in (("a.txt", b"one"), (".hidden/b.txt", b"two"), ("venv/c.md", b"x"), ("sub/d.md", FRENCH.encode("cp1252")), ("e.key", b"k")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    root = files.resolve_folder(str(tmp_path))
    got = [(os.path.relpath(r.path, root), r.size) for r in files.scan(spark, root).collect()]
    assert got == [("a.txt", 3), ("sub/d.md", len(FRENCH.encode("cp1252")))]
    assert {r.text for r in files.read_texts(spark, f"{root}/sub").collect()} == {FRENCH}
    with pytest.raises(OSError):
        files.resolve_folder(f"{root}/gone")


def test_models_give_unit_vectors_alone_and_in_a_batch():
    model = embed.HashingModel(16)
    texts = ["One two, two!", "", "...", "été"]
    both = model.embed(texts)
    assert np.allclose(np.linalg.norm(both, axis=1), 1)
    assert all(np.array_equal(model.embed([t])[0], v) for t, v in zip(texts, both, strict=True))
    assert embed.pool(np.eye(3), "cls").tolist() == [1, 0, 0] and np.allclose(embed.pool(np.eye(3), "mean"), 1 / 3)


def test_synthetic_words_follow_the_law(spark):
    rows = synthetic.passages(spark, 500)
    assert rows.count() == 500 and rows.where("size(split(text, ' ')) <> 60").count() == 0
    counts = rows.selectExpr("explode(split(text, ' ')) AS w").groupBy("w").count().orderBy("count", ascending=False).limit(1).collect()
    assert counts[0].w == "ka"
    assert synthetic.unit_vectors(spark, 5, 8).count() == 5


def test_attempts_as_a_stream(spark, tmp_path):
    schema = "path string, size long, modified_secs long, reason string, seq long"
    rows = [("a", 1, 1, "damaged", 0), ("a", 1, 1, "crashed", 1), ("a", 2, 1, "damaged", 2), ("b", 1, 1, "damaged", 3)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = progress.stream_attempts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("attempts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("SELECT * FROM attempts").collect()))
    assert got == [("a", "crashed", 2), ("a", "damaged", 1), ("a", "damaged", 1), ("b", "damaged", 1)]


def test_a_new_listing_gives_a_change_plan(spark, tmp_path):
    schema = "path string, size long, modified_secs long, cloud_only boolean"
    spark.createDataFrame([("/a.txt", 1, 1, False), ("/b.txt", 2, 1, False), ("/c.zip", 1, 1, False)], schema).coalesce(1).write.parquet(f"{tmp_path}/scans")
    stored = spark.createDataFrame([("/a.txt", 1, 1, "h"), ("/b.txt", 1, 1, "g")], "path string, size long, modified_secs long, hash string")
    none = spark.createDataFrame([], "path string, size long, modified_secs long, reason string, attempts int")
    plans = []
    run = lambda: incremental.watch(spark, f"{tmp_path}/scans", schema, lambda: (stored, none), lambda plan, n: plans.append({r.path: r.action for r in plan.collect()}), f"{tmp_path}/c").awaitTermination(120)
    run()
    run()
    assert plans == [{"/a.txt": "unchanged", "/b.txt": "read", "/c.zip": "unsupported"}]
