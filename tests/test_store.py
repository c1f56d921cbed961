"""Folder to index and back, through the command line and across changes."""

import json
import os

import pytest

from passagework import cli
from passagework.plans import indexing
from passagework.schema import Filter, Limits
from passagework.sources import embed, evalsets, files, pdf
from passagework.sources.store import NewerIndex, Store, open_or_recover


def test_index_search_change_and_purge(spark, tmp_path, capsys):
    folder, db = tmp_path / "docs", str(tmp_path / "db")
    folder.mkdir()
    (folder / "a.txt").write_text("alpha beta gamma\ndelta")
    (folder / "b.md").write_text("alpha beta gamma\ndelta")
    (folder / "c.txt").write_text("omega only here")
    (folder / "d.pdf").write_bytes(b"%PDF")
    assert cli.main(["--db", db, "index", str(folder)]) == 0
    assert "added: 3" in capsys.readouterr().out
    cli.main(["--db", db, "status"])
    assert "files: 3\ncontents: 2\npassages: 2" in capsys.readouterr().out
    cli.main(["--db", db, "search", '"alpha beta"'])
    out = capsys.readouterr().out
    assert "a.txt (+1 identical), lines 1–2" in out and "omega" not in out
    (folder / "c.txt").unlink()
    cli.main(["--db", db, "index", str(folder)])
    out = capsys.readouterr().out
    assert "unchanged: 2" in out and "removed: 1" in out
    store = Store(spark, db)
    assert store.table("passages").count() == 1 and {r.reason for r in store.table("problems").collect()} == {"damaged"}
    assert not any("omega" in r.text for r in store.table("passages").collect())


def test_versions_and_pipelines(spark, tmp_path):
    root = tmp_path / "s"
    store = Store(spark, str(root))
    assert store.outcome == "fresh" and store.use_pipeline("a") is False
    store.commit(meta={"k": "v"}, files=spark.createDataFrame([("/a", 1, 1, "h")], "path string, size long, modified_secs long, hash string"))
    assert store.use_pipeline("a") is False and store.use_pipeline("b") is True
    # until something is published, the old index stands
    again = Store(spark, str(root))
    assert again.outcome == "fine" and again.meta("k") == "v" and again.table("files").count() == 1
    (root / "manifest-00000007.json").write_text("{ not whole")
    assert Store(spark, str(root)).number == again.number
    (root / "manifest-00000009.json").write_text(json.dumps({"schema_version": 2, "tables": {}, "meta": {}}))
    assert Store(spark, str(root)).outcome == "cleared"
    (root / "manifest-00000099.json").write_text(json.dumps({"schema_version": 99, "tables": {}, "meta": {}}))
    with pytest.raises(NewerIndex):
        Store(spark, str(root))
    assert open_or_recover(spark, str(root)) == (None, "newer")
    assert open_or_recover(spark, str(tmp_path / "no" / "where")) == (None, "away")
    for m in root.glob("*manifest-*"):
        m.unlink()
    (root / "manifest-00000001.json").write_text("gone")
    store, outcome = open_or_recover(spark, str(root))
    assert outcome == "rebuilt" and store.table("files").count() == 0 and len(list(tmp_path.glob("s-damaged-*"))) == 1


def test_a_part_is_added_and_moved(spark, tmp_path):
    rows = lambda *n: spark.createDataFrame([(f"/{i}", i, 1, f"h{i}") for i in n], "path string, size long, modified_secs long, hash string")
    store = Store(spark, str(tmp_path / "a"))
    store.commit(files=rows(1, 2))
    first = store.manifest["tables"]["files"]
    store.commit(add={"files": rows(3)})
    assert store.manifest["tables"]["files"][:1] == first and store.table("files").count() == 3
    with pytest.raises(FileExistsError):
        late = Store(spark, str(tmp_path / "a"))
        store.commit(add={"files": rows(4)})
        late.commit(files=rows(9))
    store.commit(files=rows(5))
    assert store.vacuum() >= 3 and store.table("files").count() == 1
    with pytest.raises(OSError):
        store.relocate(str(tmp_path / "b"), free_bytes=1)
    moved = store.relocate(str(tmp_path / "b"), free_bytes=1 << 40)
    assert moved.table("files").count() == 1 and moved.size_bytes() > 0 and Store(spark, str(tmp_path / "a")).outcome == "fresh"
    (tmp_path / "b" / "mine.txt").write_text("stays")
    moved.delete_all()
    assert [p.name for p in (tmp_path / "b").iterdir()] == ["mine.txt"]


def test_scans_meet_odd_folders(spark, tmp_path, monkeypatch):
    root = tmp_path / "docs"
    for name in ("_notes.txt", "_drafts/x.txt", "a.txt", "locked/in.txt", "deep/er/y.md", "secret.key", ".h/z.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"words of {name}")
    (root / "link.txt").symlink_to(root / "a.txt")
    (root / "loop").symlink_to(root)
    (root / "paged.pdf").write_bytes(pdf.write(["first page words", "", "third page harbour"]))
    (root / "scan.pdf").write_bytes(pdf.write(["", ""]))
    (root / "long.pdf").write_bytes(pdf.write(["x"] * 12))
    store = Store(spark, str(tmp_path / "db"))
    limits = Limits(max_pages=10)
    report = indexing.index_folder(spark, store, str(root), limits)
    names = {os.path.relpath(r.path, root) for r in store.table("files").collect()}
    assert names == {"_notes.txt", "_drafts/x.txt", "a.txt", "locked/in.txt", "deep/er/y.md", "paged.pdf"} and report["added"] == 6
    assert {os.path.basename(r.path): r.reason for r in store.table("problems").collect()} == {"scan.pdf": "needs-ocr", "long.pdf": "too-large"}
    assert [(r.page, r.text) for r in store.table("passages").where("page is not null").orderBy("ordinal").collect()] == [(1, "first page words"), (3, "third page harbour")]
    assert tuple(indexing.damage(store).first())[1:] == (0, 0, 0, 0, 0)
    # nothing is opened where nothing changed, and what can't be listed is kept
    real = files.read_file
    monkeypatch.setattr(files, "read_file", lambda path, limits: (_ for _ in ()).throw(AssertionError(path)))
    assert indexing.index_folder(spark, store, str(root), limits)["unchanged"] == 6
    monkeypatch.setattr(files, "read_file", real)
    monkeypatch.setattr(files, "_entries", without(str(root / "locked")))
    report = indexing.index_folder(spark, store, str(root), limits)
    assert report["unreadable"] == 1 and report["removed"] == 0 and store.table("files").count() == 6
    (root / "deep/er/y.md").unlink()
    (root / "new.txt").write_text("a new harbour")
    report = indexing.index_folder(spark, store, str(root), limits)
    assert (report["added"], report["removed"]) == (1, 1) and tuple(indexing.damage(store).first())[1:] == (0, 0, 0, 0, 0)
    with pytest.raises(OSError):
        indexing.index_folder(spark, store, str(tmp_path / "gone"))
    assert store.table("files").count() == 6


def without(locked):
    """``_entries`` that can't list one folder."""
    inner = files._entries

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield from inner(iter([batch[batch["path"] != locked]]))
            if (batch["path"] == locked).any():
                yield pd.DataFrame([(locked, True, 0, 0, False, True)], columns=[f.split()[0] for f in files.ENTRIES.split(", ")])

    return run


def test_search_by_meaning_names_and_filters(spark, tmp_path, capsys):
    folder, db = tmp_path / "docs", str(tmp_path / "db")
    (folder / "sub").mkdir(parents=True)
    (folder / "boats.txt").write_text("the harbour has many boats and ships " + "calm water " * 40)
    (folder / "sub" / "bread.md").write_text("flour water salt and yeast make bread")
    (folder / "empty-harbour-list.txt").write_text("nothing of interest")
    store = Store(spark, db)
    indexing.index_folder(spark, store, str(folder))
    assert indexing.ask(store, "harbour", model=embed.HashingModel())[1] == "not-embedded-yet"
    assert indexing.embed_missing(store, embed.HashingModel()) == 3 and indexing.embed_missing(store, embed.HashingModel()) == 0
    hits, note = indexing.ask(store, "harbour boats", model=embed.HashingModel())
    assert note is None and hits[0]["name"] == "boats.txt" and hits[0]["found"] == "both" and "\x02harbour\x03" in hits[0]["snippet"]
    assert any(h["name"] == "empty-harbour-list.txt" for h in indexing.ask(store, "empty harbour list")[0])
    only = indexing.ask(store, "water", model=embed.HashingModel(), f=Filter(folders=(f"{folder}/sub",)))[0]
    assert {h["name"] for h in only} == {"bread.md"}
    assert indexing.ask(store, "...")[0] == []
    cli.main(["--db", db, "search", "bread", "--kind", "md", "--since", "year"])
    out = capsys.readouterr().out
    assert "bread.md" in out and "[bread]" in out and "found by" in out
    indexing.embed_missing(store, embed.HashingModel(16))
    assert indexing.ask(store, "bread", model=embed.HashingModel())[1] == "other-model hashing@1 16"
    cli.main(["--db", db, "problems"])


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# minimums\ncombined all recall@10 0.9  # note\n\nwords kind:exact mrr@10 0.5\n")
    assert [tuple(r) for r in evalsets.read_thresholds(spark, str(tmp_path / "t.txt")).collect()] == [("combined", "all", "recall", 0.9), ("words", "kind:exact", "mrr", 0.5)]
    (tmp_path / "q.tsv").write_text("# kind\nexact\ten\tletter\tred house\twhere?\n")
    docs = spark.createDataFrame([("letter", "a\nthe red  house\nb")], "document string, text string")
    assert evalsets.read_queries(spark, str(tmp_path / "q.tsv"), docs).first().line == 2
    data = {"data": [{"paragraphs": [{"context": "a  b", "qas": [{"question": "q?", "answers": [{"text": "b"}]}]}]}] * 2}
    (tmp_path / "x.json").write_text(json.dumps(data))
    paragraphs, queries = evalsets.read_articles(spark, str(tmp_path / "x.json"), "en", 0)
    assert [tuple(r) for r in paragraphs.collect()] == [(0, 1, "en", "a b")] and queries.count() == 2
