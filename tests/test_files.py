import base64
import json

import pytest
from pyspark.sql import functions as F

from tests.test_containers import docx, mail
from umbra import cli
from umbra.operators import routing, semantic, verify
from umbra.sources import ingest


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "in/a.txt": b"mail a@b.com\r\nssn 123-45-6789", "in/sub/b.csv": b"x,1", "in/a.redacted.txt": b"done", "in/.git/HEAD": b"ref", "in/node_modules/p.js": b"js",
        "in/noext": b"%PDF-1.4", "in/raw": b"\x00\x01", "in/w.docx": docx(), "in/m.eml": mail(), ".hidden.txt": b"h",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def names(df):
    return sorted((r.name, r.media_type) for r in df.select("name", "media_type").collect())


def test_scan(spark, tree):
    top = str(tree / "in")
    assert names(ingest.documents(spark, [top])) == [("a.txt", "text"), ("b.csv", "structured"), ("m.eml", "email"), ("noext", "pdf"), ("w.docx", "docx")]
    assert ("b.csv", "structured") not in names(ingest.documents(spark, [top], recursive=False))
    assert ("raw", "unknown") in names(ingest.documents(spark, [top], include_unknown=True))
    assert ("a.redacted.txt", "text") in names(ingest.documents(spark, [top], include_outputs=True))
    twice = ingest.documents(spark, [f"{top}/a.txt", f"{top}/*.txt"])
    assert names(twice) == [("a.txt", "text")] * 2
    assert ingest.unmatched([top, f"{top}/typo", f"{top}/*.none"]) == [f"{top}/typo", f"{top}/*.none"]
    assert ingest.documents(spark, [f"{top}/typo"]).count() == 0


@pytest.mark.parametrize("content,want", [
    (b"", "unknown"), (b"PK\x03\x04", "unknown"), (b"%PDF-1", "pdf"), (b"\x89PNG\r\n\x1a\n", "image"), (b"BMx", "image"), (b"RIFF....WEBP", "image"), (b"RIFF....AVI ", "video"), (b"RIFF....WAVE", "image"),
    (b"plain\ttext\n", "text"), (b"nul\0", "unknown"), ("é".encode() * 9, "text"), (b"123456789012345" + "é".encode(), "unknown"),
])
def test_sniff(spark, content, want):
    assert spark.range(1).select(ingest.sniff(F.lit(bytearray(content)))).first()[0] == want


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    path = lambda p, root, out: one(ingest.output_path(F.lit(p), F.lit(root).cast("string"), out))
    assert path("/in/s/a.txt", "/in", "/out") == "/out/s/a.redacted.txt"
    assert path("/in/s/a.txt", None, "/out") == "/out/a.redacted.txt" == path("/else/a.txt", "/in", "/out")
    assert path("/in/a", "/in", None) == "/in/a.redacted"
    assert ingest.glob_root("inbox/**/*.txt") == "inbox" and ingest.glob_root("/abs/dir/*.csv") == "/abs/dir" and ingest.glob_root("*.txt") == "."
    assert one(ingest.decode(F.lit(bytearray(b"a\r\nb\rc\xff")))) == "a\nb\nc�"


def test_routing(spark):
    up = {n: n in ("builtin", "presidio") for n, *_ in routing.BACKENDS}
    docs = spark.createDataFrame([("a.txt", "text"), ("b.pdf", "pdf"), ("c.bin", "unknown")], "name string, media_type string")
    route = lambda backend="auto", **k: {r.name: (r.backend, r.error) for r in routing.route(docs, routing.backends(spark, available=up, **k), backend).collect()}
    auto = route()
    assert auto["a.txt"] == ("presidio", None) and auto["b.pdf"][0] is None and "no *available* backend" in auto["b.pdf"][1] and "no backend supports" in auto["c.bin"][1]
    assert route("builtin")["a.txt"] == ("builtin", None) and "does not support" in route("builtin")["b.pdf"][1]
    assert "unknown backend" in route("x")["a.txt"][1] and "not available" in route("pymupdf")["b.pdf"][1]
    assert route(registered=[("mine", ("unknown",), 1, (), "")])["c.bin"][0] == "mine"
    assert routing.listing(routing.backends(spark, available=up)).first()["name"] == "presidio"


def layers(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_verify_decodes_and_needs_a_control(spark):
    wrapped = base64.encodebytes(b"x" * 50 + b" ssn 123-45-6789 " + b"y" * 60).decode()
    found = layers(spark, ("/o/a.redacted.txt", "Content: x;\n\n" + wrapped), ("/o/b.redacted.txt", "clean http://www.w3.org/x"), ("/o/c.redacted.txt", "a@b.com a@b.com"))
    got = {r.path[3]: r for r in verify.verify(found).collect()}
    assert [got[x].status for x in "abc"] == ["LEAKING", "clean", "LEAKING"] and got["c"].finding_count == 1 and got["a"].control_entities is None
    origins = layers(spark, ("/i/a.txt", "a@b.com a@b.com"), ("/i/b.txt", "nothing"))
    got = {r.path[3]: r for r in verify.verify(found, origins).collect()}
    assert (got["a"].control_entities, got["b"].status, got["c"].control_entities) == (2, "INCONCLUSIVE", None)
    s = verify.verify_summary(verify.verify(found, origins)).first()
    assert (s.artifacts, s.leaking, s.inconclusive, s.exit_code) == (3, 2, 1, 1)


def test_search_ranks_and_filters(spark):
    index = spark.createDataFrame([(0, "bus.jpg", [1.0, 0.0, 0.0]), (1, "clip.mp4", [0.5, 0.5, 0.0]), (2, "clip.mp4", [1.0, 0.0, 0.0]), (3, "noise.png", [0.0, 0.0, 0.0])], "vec_id long, path string, embedding array<float>")
    hits = semantic.search(index, [2.0, 0.0, 0.0], [[0.0, 1.0, 0.0]], top_k=2, file_col="path").collect()
    assert [(r.path, r.vec_id) for r in hits] == [("bus.jpg", 0), ("clip.mp4", 2)] and hits[0].score > 0.99
    assert semantic.search(index, [1.0, 0.0, 0.0], threshold=0.5).count() == 3
    docs = spark.createDataFrame([("bus.jpg", "image"), ("noise.png", "image"), ("a.txt", "text")], "path string, media_type string")
    assert sorted(r.path for r in semantic.filter_documents(docs, index.where("vec_id = 0")).collect()) == ["a.txt", "bus.jpg"]
    frames = spark.range(1).select(semantic.frame_sample(F.lit(10), 3).alias("a"), semantic.frame_sample(F.lit(0), 3).alias("b")).first()
    assert frames.a == [0, 3, 6] and frames.b == []


def test_command_line_reports(spark, tree, capsys):
    top, out, report = str(tree / "in"), str(tree / "out"), str(tree / "reports/run.json")
    assert cli.main(["run", f"{top}/a.txt", f"{top}/noext", "-o", out, "--json", report, "--lang", "de", "--yolo-classes", "a, b", "--yolo-model", "m.pt"], spark) == 1
    assert "no *available* backend for pdf (noext)" in capsys.readouterr().out
    made = json.load(open(report))
    assert made["summary"] == {"documents": 2, "failed": 1, "incomplete": 0, "entities": 2, "all_safe": False, "exit_code": 1}
    assert [d["success"] for d in made["documents"]] == [True, False] and made["contains_pii_values"] is False
    assert cli.main(["verify", f"{top}/a.txt", "--json", report, "--json-include-values"], spark) == 1
    made = json.load(open(report))
    assert made["summary"]["leaking"] == 1 and {f["text"] for f in made["artifacts"][0]["findings"]} == {"a@b.com", "123-45-6789"} and made["artifacts"][0]["media_type"] == "text"
    assert cli.main(["verify", f"{top}/a.txt", "--json", report], spark) == 1
    assert "a@b.com" not in open(report).read()
    assert cli.main(["verify", f"{out}/a.redacted.txt", "--json", f"{top}/a.txt/no/folder.json"], spark) == 0  # the report fails, the answer stands
    assert cli.main(["detect", top], spark) == 0
    said = capsys.readouterr().out
    assert "skipped" in said and "raw: unknown type" in said


def test_a_failed_write_is_a_failed_row(spark, tree, capsys):
    (tree / "blocked").write_text("a file where a folder should be")
    assert cli.main(["run", f"{tree}/in/a.txt", f"{tree}/in/sub", "-o", f"{tree}/blocked"], spark) == 1
    assert capsys.readouterr().out.count("FAIL") == 2


def test_library(spark, tree):
    import umbra

    top = str(tree / "in")
    missed = []
    docs = list(umbra.iter_documents(spark, [f"{top}/sub", top], skipped=missed))
    assert [d.name for d in docs][:1] == ["b.csv"] and sorted(d.name for d in docs) == ["a.txt", "b.csv", "b.csv", "m.eml", "noext", "w.docx"] and [x.rsplit("/", 1)[1] for x in missed] == ["raw"]
    one = umbra.load_document(spark, f"{top}/a.txt")
    assert one.read_text() == "mail a@b.com\nssn 123-45-6789" and umbra.detect_media_type(spark, f"{top}/noext") == umbra.MediaType.PDF
    with pytest.raises(FileNotFoundError):
        umbra.load_document(spark, f"{top}/typo")
    with pytest.raises(IsADirectoryError):
        umbra.load_document(spark, top)
    suite = umbra.RedactionSuite(spark, options=umbra.RedactionOptions(output_dir=str(tree / "lib"), mode="mask"))
    got = {r.source.rsplit("/", 1)[1]: r for r in suite.redact_paths([top])}
    assert got["a.txt"].fully_redacted and got["a.txt"].entity_counts == {"EMAIL_ADDRESS": 1, "US_SSN": 1} and (tree / "lib/a.redacted.txt").exists()
    assert "incomplete" in got["m.eml"].summary() and "failed" in got["noext"].summary() and str(got["a.txt"].entities[0]) == "EMAIL_ADDRESS[5:12] (0.85)"
    registry = umbra.BackendRegistry.with_defaults()
    assert umbra.select_backend(one, umbra.RedactionOptions(), registry).name == "builtin" and [b.name for b in umbra.candidates(one, registry)] == ["builtin", "presidio", "philter", "redactai"]
    with pytest.raises(umbra.RoutingError):
        umbra.select_backend(umbra.load_document(spark, f"{top}/raw"), umbra.RedactionOptions(), registry)
    assert suite.describe_backends().first()["name"] == "builtin"


def test_command_line(spark, tree, capsys):
    top, out = str(tree / "in"), str(tree / "out")
    assert cli.main(["list"], spark) == 0 and "builtin" in capsys.readouterr().out
    assert cli.main(["detect", f"{top}/none"], spark) == 1
    capsys.readouterr()
    assert cli.main(["run", f"{top}/a.txt", "-o", out, "--json", "-"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["summary"]["entities"] == 2 and "a@b.com" not in json.dumps(report)
    assert (tree / "out/a.redacted.txt").read_text() == "mail <EMAIL_ADDRESS>\nssn <US_SSN>"
    assert cli.main(["run", f"{top}/m.eml", "-o", out], spark) == 1  # an attachment stays
    assert cli.main(["run", f"{top}/a.txt", "-o", str(tree / "dry"), "--dry-run"], spark) == 0 and not (tree / "dry").exists()
    assert cli.main(["verify", f"{out}/a.redacted.txt", "--original", top], spark) == 0
    assert cli.main(["verify", f"{top}/a.txt"], spark) == 1
    assert cli.main(["verify", f"{out}/a.redacted.txt", "--original", f"{top}/typo"], spark) == 2
    assert cli.main(["search", "a bus", top], spark) == 2  # no model is installed
    assert cli.main(["run", top, "--match", "a bus"], spark) == 2
    assert cli.labels(["email_address, us_ssn", "URL"]) == ["EMAIL_ADDRESS", "US_SSN", "URL"] and cli.labels([","]) is None
