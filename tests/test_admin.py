"""Settings, logs, sessions, checks and PDF pages."""

import hashlib
import json
import zlib

import pytest

from passagework.schema import Limits
from passagework.sources import admin, pdf


def test_settings_survive_damage(tmp_path):
    s = admin.Settings(str(tmp_path))
    assert s.outcome == "fresh" and s.limits().max_file_bytes == 200 << 20
    s.save(folders=["/a"])
    s.save(folders=["/a", "/b"])
    assert admin.Settings(str(tmp_path)).values["folders"] == ["/a", "/b"]
    s.path.write_text("{ half")
    again = admin.Settings(str(tmp_path))
    assert again.outcome == "previous" and again.values["folders"] == ["/a"]
    s.previous.write_text("[]")
    assert admin.Settings(str(tmp_path)).outcome == "damaged"
    s.path.write_text(json.dumps({"folder": "/old", "max_bytes": 5 << 20}))
    old = admin.Settings(str(tmp_path))
    assert old.values["version"] == 2 and old.values["folders"] == ["/old"] and old.limits().max_file_bytes == 5 << 20


def test_log_turns_over_and_keeps_private_lines_back(tmp_path, monkeypatch):
    monkeypatch.setattr(admin, "LOG_BYTES", 2_000)
    log = admin.Log(str(tmp_path), private=True)
    for i in range(100):
        log.write("info", "step", {"n": i}, {"path": f"/p{i}"} if i % 2 else None)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log.jsonl", "log.jsonl.1", "log.jsonl.2"]
    lines = log.tail(10)
    assert [json.loads(x)["values"]["n"] for x in lines] == list(range(90, 100))
    assert [json.loads(x)["values"]["n"] for x in admin.public_lines([*lines, "junk", "{}"])] == [90, 92, 94, 96, 98]
    quiet = admin.Log(str(tmp_path / "q"))
    quiet.write("warn", "open", None, {"path": "/secret"})
    assert "secret" not in quiet.tail(1)[0]


def test_sessions_count_unclean_ends(spark, tmp_path):
    for want in (0, 1, 2):
        s = admin.Session(str(tmp_path))
        assert s.unclean == want
    assert s.safe_mode
    s.end()
    assert admin.Session(str(tmp_path)).unclean == 0
    s.path.write_text("x")
    assert admin.Session(str(tmp_path)).unclean == 0
    rows = spark.createDataFrame([("m", i, c) for i, c in enumerate([True, False, False, True, False])], "m string, at int, clean boolean")
    assert [r.unclean for r in admin.unclean_streaks(rows, "m", "clean", "at").orderBy("at").collect()] == [0, 0, 1, 2, 0]


def test_checks(tmp_path):
    assert [admin.pause_reason(*x) for x in ((True, 0, "fine", 0, True), (False, 5, "fine", 0, False), (False, None, "newer", 0, False), (False, None, "away", 0, False), (False, 1 << 40, "fine", 2, False), (False, None, "fine", 0, True), (False, None, "fine", 1, False))] == ["you", "low-disk", "newer-index", "index-away", "safe-mode", "battery", None]
    (tmp_path / "a.TXT").write_text("x")
    (tmp_path / "a.exe").write_text("x")
    assert admin.may_open(str(tmp_path / "a.TXT")) and not admin.may_open(str(tmp_path / "a.exe")) and not admin.may_open(str(tmp_path / "b.txt"))
    base = "https://example.org/releases/"
    assert admin.allowed_download(base + "v1.0/app.zip", base)
    assert not any(admin.allowed_download(base + x, base) for x in ("v1/../x", "v1/a/b", "v1", "/a", "v1/a?b", "../x", "v 1/a")) and not admin.allowed_download("https://example.com/v1/a", base)
    digest = hashlib.sha256(b"x").hexdigest()
    assert admin.find_model("a.TXT", [str(tmp_path)], digest).endswith("a.TXT") and admin.find_model("none", [str(tmp_path)], digest) is None
    with pytest.raises(ValueError):
        admin.verified(str(tmp_path / "a.TXT"), "00", [str(tmp_path)])
    with pytest.raises(PermissionError):
        admin.verified("/etc/passwd", digest, [str(tmp_path)])
    assert admin.model_identity("small", "0123456789abcdef", 384) == "small@0123456789ab 384"


def test_diagnostics_and_deletion(spark, tmp_path):
    problems = spark.createDataFrame([("/a", 1, 1, "damaged", 2), ("/b", 1, 1, "damaged", 1), ("/c", 1, 1, "too-large", 1)], "path string, size long, modified_secs long, reason string, attempts int")
    settings, log = admin.Settings(str(tmp_path)), admin.Log(str(tmp_path))
    settings.save(folders=["/home"])
    log.write("info", "start")
    (tmp_path / "crash-1.txt").write_text("x")
    (tmp_path / "mine.txt").write_text("x")
    got = admin.diagnostics(problems, settings, log)
    assert got["problems"] == [{"code": "damaged", "n": 2, "parked": 1}, {"code": "too-large", "n": 1, "parked": 0}]
    assert "folders" not in got["settings"] and len(got["log"]) == 1 and got["crashes"] == ["crash-1.txt"]
    admin.delete_everything(spark, str(tmp_path / "index"), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["mine.txt"]


def reason(data, limits=None):
    with pytest.raises(pdf.Refused) as refused:
        pdf.pages(data, limits or Limits())
    return refused.value.reason


def test_pdf_pages():
    for compressed in (True, False):
        assert pdf.pages(pdf.write(["One (two) \\ three é", "", "page 3"], compressed), Limits()) == ["One (two) \\ three é", "", "page 3"]
    many = pdf.write(["x" * 100] * 11)
    assert reason(many, Limits(max_pages=10)) == "too-large" and reason(many, Limits(max_text_bytes=500)) == "too-large"
    assert reason(b"plain") == "damaged" and reason(b"%PDF-1.7 nothing") == "damaged"
    assert reason(many.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")) == "encrypted"


def test_pdf_object_streams_and_maps():
    content = b"BT /F1 9 Tf 10 700 Td <00010002> Tj 0 -12 Td [(\x00\x03) -300 (\x00\x01)] TJ ET"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 4 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>", b"<< /Type /Font /ToUnicode 5 0 R >>"]
    head, body = b"", b""
    for n, o in enumerate(inner, 1):
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = zlib.compress(head + body)
    data = b"%PDF-1.5\n7 0 obj << /Type /ObjStm /N 4 /First " + b"%d" % len(head) + b" /Filter /FlateDecode /Length 8 0 R >> stream\n" + packed + b"\nendstream endobj\n8 0 obj %d endobj\n" % len(packed)
    for n, s in ((5, cmap), (6, content)):
        data += b"%d 0 obj << /Length %d >> stream\r\n" % (n, len(s)) + s + b"\r\nendstream endobj\n"
    assert pdf.pages(data, Limits()) == ["Жa\nb Ж"]


def test_pdf_takes_any_bytes():
    import random

    r, good = random.Random(7), pdf.write(["some words here", "more"], False)
    for _ in range(300):
        data = bytearray(good)
        for _ in range(r.randint(1, 12)):
            data[r.randrange(len(data))] = r.randrange(256)
        try:
            assert all(isinstance(t, str) for t in pdf.pages(bytes(data[: r.randint(0, len(data))]), Limits()))
        except pdf.Refused as refused:
            assert refused.reason in ("damaged", "encrypted", "too-large")
