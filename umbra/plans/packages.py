"""Queries on packages and mail that are made from ``customer``, with their SQL.

Every customer gets a Word, an Excel and a PowerPoint package and a mailbox whose texts
follow from the key, so that SQL can say what reading and rewriting them must give.
"""

from __future__ import annotations

import re
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import recognizers, spans
from umbra.operators import backends, results, routing, semantic, verify
from umbra.plans.catalog import _RAW, _vectors, query, spread, table
from umbra.sources import containers, ingest
from umbra.sources.containers import Settings

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>kept</dc:title><dc:creator>Author {k}</dc:creator><cp:lastModifiedBy>Editor {k}</cp:lastModifiedBy></cp:coreProperties>'
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
_KEY = "SELECT c_custkey AS key, 'user' || c_custkey || '@example.com' AS mail, '123-45-' || lpad(cast(c_custkey % 9999 + 1 AS varchar), 4, '0') AS ssn FROM customer"


def _zip(parts: dict) -> bytes:
    members = ((n, d.encode() if isinstance(d, str) else d) for n, d in parts.items())
    return containers.write_zip([(n, d, (zipfile.ZIP_STORED, d)) for n, d in members])


def _word(k: int, mail: str, ssn: str) -> bytes:
    run = lambda *ts: "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in ts)
    body = (
        f"<w:p>{run('mail user', f'{k}@exam', 'ple.com ok')}</w:p><w:p><w:r><w:t>ssn</w:t><w:tab/><w:t>{ssn}</w:t></w:r></w:p><w:p><w:r><w:t>line {k}</w:t><w:br/><w:t>two</w:t></w:r></w:p>"
        f'<w:p><w:del w:author="Author {k}" w:initials="A{k}"><w:r><w:delText>gone {ssn[:5]}</w:delText></w:r><w:r><w:delText>{ssn[5:]}</w:delText></w:r></w:del></w:p>'
        f'<w:p><w:r><w:instrText>HYPERLINK "mailto:</w:instrText></w:r><w:r><w:instrText>{mail}"</w:instrText></w:r><w:fldSimple w:instr="REF {mail}"/></w:p>'
    )
    return _zip({
        "[Content_Types].xml": _TYPES, "word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr {_W}><w:p><w:r><w:t>call (415) 555-0132</w:t></w:r></w:p></w:hdr>", "docProps/core.xml": _CORE.format(k=k),
        "word/_rels/document.xml.rels": f'<Relationships {_REL}><Relationship Id="r1" Type="t" Target="mailto:{mail}" TargetMode="External"/><Relationship Id="r2" Type="t" Target="media/face.jpeg"/><Relationship Id="r3" Type="t" Target="media/face.gif"/></Relationships>',
        "word/media/face.jpeg": b"\xff\xd8\xff" + str(k).encode(), "word/media/face.gif": b"GIF89a" + str(k).encode(),
    })


def _excel(k: int, mail: str, ssn: str) -> bytes:
    used = "".join(f'<c r="D{i}" t="s"><v>3</v></c>' for i in range(1, 2 + k % 9))
    return _zip({
        "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="Staff" sheetId="1" r:id="rId7"/><sheet name="Log" sheetId="2" r:id="rId8"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {_REL}><Relationship Id="rId7" Type="t" Target="worksheets/sheet1.xml"/><Relationship Id="rId8" Type="t" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {_S}><si><t>plain {k}</t></si><si><r><t>user{k}@</t></r><r><t>example.com</t></r></si><si><t>unused {ssn}</t></si><si><t>ssn {ssn}</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {_S}><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><v>{k}</v></c><c r="B2" t="str"><f>F(1)</f><v>to {mail}</v></c></row></sheetData><headerFooter><oddFooter>{ssn}</oddFooter></headerFooter><hyperlinks><hyperlink ref="A1" display="{mail}"/></hyperlinks></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {_S}><sheetData><row>{used}<c r="C8" t="inlineStr"><is><t>in {mail}</t></is></c></row></sheetData></worksheet>',
        "xl/comments1.xml": f"<comments {_S}><authors><author>Author {k}</author></authors><commentList><comment><text><t>call (415) 555-0132</t></text></comment></commentList></comments>",
        "docProps/core.xml": _CORE.format(k=k),
    })


def _point(k: int, mail: str, ssn: str) -> bytes:
    return _zip({
        "ppt/presentation.xml": f"<p:presentation {_P}/>",
        "ppt/slides/slide1.xml": f"<p:sld {_P}><a:p><a:r><a:t>to user{k}</a:t></a:r><a:r><a:t>@example.com</a:t></a:r></a:p><a:p><a:r><a:t>page {k}</a:t></a:r></a:p></p:sld>",
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {_P}><a:p><a:r><a:t>say {ssn}</a:t></a:r></a:p></p:notes>",
        "ppt/charts/chart1.xml": f'<c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:v>{mail}</c:v></c:chart>',
        "ppt/commentAuthors.xml": f'<p:cmAuthorLst {_P}><p:cmAuthor name="Author {k}" initials="A{k}"/></p:cmAuthorLst>',
        "ppt/embeddings/book.xlsx": b"PK",
    })


def _mailbox(k: int, mail: str, ssn: str) -> bytes:
    from base64 import b64encode

    first = f"From box{k}@example.org Thu Jan  1 00:00:00 1970\nFrom: {mail}\nReceived: by a for {mail}\nReceived: by b for {mail}\nX-Kept: {mail}\nSubject: hello {k}\n\nssn {ssn}\n"
    inner = f"From: inner{k}@example.com\nSubject: again\n\nforwarded {ssn}\n"
    second = (
        f'From box{k}@example.org Thu Jan  1 00:00:00 1970\nTo: {mail}\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n'
        f'--b\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n{b64encode(f"né {mail}".encode()).decode()}\n'
        f'--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="f{k}.bin"\nContent-Transfer-Encoding: base64\n\nAAEC\n'
        f"--b\nContent-Type: message/rfc822\n\n{inner}\n--b--\n"
    )
    return (first + second).encode()


MAKERS = {"docx": _word, "xlsx": _excel, "pptx": _point, "email": _mailbox}


def packages(spark, sf_dir, kind: str) -> DataFrame:
    """(path, media_type, content) with the customer's key as path."""

    def made(k):
        return [(str(k), kind, MAKERS[kind](k, f"user{k}@example.com", f"123-45-{k % 9999 + 1:04d}"))]

    keys = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return containers.map_files(keys, ("c_custkey",), made, "path string, media_type string, content binary")


def _keyed(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.col("path").cast("long").alias("key"), *columns)


def texts(rows: DataFrame) -> DataFrame:
    def read(path, kind, raw):
        return [(path, containers.mail_text(raw) if kind == "email" else containers.package_text(kind, raw))]

    return containers.map_files(rows, ("path", "media_type", "content"), read, "path string, text string")


def parts(rows: DataFrame, patterns: dict[str, tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """One column for each (part, pattern): what the pattern's group finds in the part of
    a rewritten package, repeats joined by a bar. ``*`` stands for the names of parts.
    The columns ``keep`` stay beside them, so a file is rewritten once for all columns."""

    def one(*values):
        *kept, raw = values
        z = containers.Members(raw)
        held = {n: z.read(n).decode("utf-8", "replace") for n in {n for n, _ in patterns.values()} - {"*"}}
        held["*"] = "\n".join(sorted(z.names()))
        return [(*kept, *("|".join(re.findall(p, held[n])) for n, p in patterns.values()))]

    kept = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return containers.map_files(rows, ("path", *keep, "content"), one, f"path string, {kept}" + ", ".join(f"`{n}` string" for n in patterns))


# -- Word ------------------------------------------------------------------------------
@query(f"SELECT key, 'mail ' || mail || ' ok' || chr(10) || 'ssn' || chr(9) || ssn || chr(10) || 'line ' || key || chr(10) || 'two' || chr(10) || 'call (415) 555-0132' AS text FROM ({_KEY})")
def docx_extract_text(spark, sf_dir):
    return _keyed(texts(packages(spark, sf_dir, "docx")), "text")


@query(f"SELECT key, 'mail <EMAIL_ADDRESS> ok' || chr(10) || 'ssn' || chr(9) || '<US_SSN>' || chr(10) || 'line ' || key || chr(10) || 'two' || chr(10) || 'call <PHONE_NUMBER>' AS redacted, true AS success, '2 embedded image(s) left untouched' AS message FROM ({_KEY})")
def docx_rewrite(spark, sf_dir):
    rows = containers.rewrite_containers(packages(spark, sf_dir, "docx"))
    return _keyed(rows, F.col("redacted_text").alias("redacted"), "success", "message")


@query(f"""WITH k AS ({_KEY}), p AS (SELECT *, 6 + length(mail) + 4 AS second, 6 + length(mail) + 3 + 16 + length('line ' || key) + 5 + 5 AS third FROM k)
SELECT key, e.t AS entity_type, cast(e.s AS int) AS "start", cast(e.e AS int) AS "end", e.v AS text FROM (SELECT key, unnest([
 {{'t': 'EMAIL_ADDRESS', 's': 5, 'e': 5 + length(mail), 'v': mail}}, {{'t': 'US_SSN', 's': length('mail ' || mail || ' ok') + 1 + 4, 'e': length('mail ' || mail || ' ok') + 1 + 4 + 11, 'v': ssn}},
 {{'t': 'PHONE_NUMBER', 's': length('mail ' || mail || ' ok_ssn_' || ssn || '_line ' || key || '_two_call '), 'e': length('mail ' || mail || ' ok_ssn_' || ssn || '_line ' || key || '_two_call (415) 555-0132'), 'v': '(415) 555-0132'}},
 {{'t': 'US_SSN', 's': NULL, 'e': NULL, 'v': ssn}}, {{'t': 'EMAIL_ADDRESS', 's': NULL, 'e': NULL, 'v': mail}}, {{'t': 'EMAIL_ADDRESS', 's': NULL, 'e': NULL, 'v': mail}}, {{'t': 'EMAIL_ADDRESS', 's': NULL, 'e': NULL, 'v': mail}},
 {{'t': 'DOCUMENT_AUTHOR', 's': NULL, 'e': NULL, 'v': 'Author ' || key}}, {{'t': 'DOCUMENT_AUTHOR', 's': NULL, 'e': NULL, 'v': 'A' || key}}, {{'t': 'DOCUMENT_AUTHOR', 's': NULL, 'e': NULL, 'v': 'Author ' || key}}, {{'t': 'DOCUMENT_AUTHOR', 's': NULL, 'e': NULL, 'v': 'Editor ' || key}}]) AS e FROM k)""")
def docx_entities(spark, sf_dir):
    """Offsets over the visible text; what is hidden, metadata or a link has none."""
    rows = containers.rewrite_containers(packages(spark, sf_dir, "docx"), dry_run=True).select("path", F.explode("entities").alias("e"))
    return _keyed(rows, "e.entity_type", "e.start", "e.end", "e.text")


@query(f"""SELECT key, 'gone <US_SSN>|' AS deleted, 'HYPERLINK "mailto:|<EMAIL_ADDRESS>"' AS codes, 'REF <EMAIL_ADDRESS>' AS field, '<DOCUMENT_AUTHOR>' AS author, '<DOCUMENT_AUTHOR>' AS initials, '<DOCUMENT_AUTHOR>' AS creator, '<DOCUMENT_AUTHOR>' AS editor, 'kept' AS title, 'mailto:<EMAIL_ADDRESS>|media/face.jpeg|media/face.gif' AS targets FROM ({_KEY})""")
def docx_hidden_and_metadata(spark, sf_dir):
    rows = containers.rewrite_containers(packages(spark, sf_dir, "docx"))
    found = parts(rows, {
        "deleted": ("word/document.xml", r"<w:delText[^>]*?(?:/>|>([^<]*)<)"), "codes": ("word/document.xml", r"<w:instrText[^>]*>([^<]*)<"), "field": ("word/document.xml", r'w:instr="([^"]*)"'),
        "author": ("word/document.xml", r'w:author="([^"]*)"'), "initials": ("word/document.xml", r'w:initials="([^"]*)"'), "creator": ("docProps/core.xml", r"<\w+:creator>([^<]*)<"),
        "editor": ("docProps/core.xml", r"<\w+:lastModifiedBy>([^<]*)<"), "title": ("docProps/core.xml", r"<\w+:title>([^<]*)<"), "targets": ("word/_rels/document.xml.rels", r'Target="([^"]*)"'),
    })
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')).alias(c)
    return _keyed(found, *[plain(c) for c in found.columns[1:]])


@query(f"SELECT key, 'word/media/face-2.png|word/media/face.png' AS media, 'media/face.png|media/face-2.png' AS targets, 'png' AS png, cast(2 AS bigint) AS images, '2 embedded image(s) stripped' AS message FROM ({_KEY})")
def docx_images_stripped(spark, sf_dir):
    """Two pictures of one stem stay two; parts, relations and content types follow."""
    rows = containers.rewrite_containers(packages(spark, sf_dir, "docx"), Settings(images="strip"))
    counted = rows.withColumn("images", F.size(F.filter("entities", lambda e: e["entity_type"] == "EMBEDDED_IMAGE")).cast("long"))
    found = parts(counted, {"media": ("*", "(?m)^(word/media/.*)$"), "targets": ("word/_rels/document.xml.rels", r'Target="(media[^"]*)"'), "png": ("[Content_Types].xml", 'Extension="(png)"')}, ("images", "message"))
    return _keyed(found, "media", "targets", "png", "images", "message")


# -- Excel -----------------------------------------------------------------------------
@query(f"SELECT key, 'plain ' || key || chr(10) || mail || chr(10) || 'unused ' || ssn || chr(10) || 'ssn ' || ssn || chr(10) || 'in ' || mail || chr(10) || 'call (415) 555-0132' AS text FROM ({_KEY})")
def xlsx_extract_text(spark, sf_dir):
    return _keyed(texts(packages(spark, sf_dir, "xlsx")), "text")


@query(f"""SELECT key, 'plain ' || key || chr(10) || '<EMAIL_ADDRESS>' || chr(10) || 'unused <US_SSN>' || chr(10) || 'ssn <US_SSN>' || chr(10) || 'to <EMAIL_ADDRESS>' || chr(10) || 'in <EMAIL_ADDRESS>' || chr(10) || 'call <PHONE_NUMBER>' AS redacted,
 'EMAIL_ADDRESS at Staff!A1; US_SSN at ' || array_to_string(list_transform(range(1, 2 + least(key % 9, 5)), lambda i: 'Log!D' || i), ', ') || CASE WHEN key % 9 > 5 THEN ' (+' || (key % 9 - 5) || ' more)' ELSE '' END AS message FROM ({_KEY})""")
def xlsx_rewrite_and_places(spark, sf_dir):
    """Shared strings once for all their cells, whose places are told by sheet names."""
    return _keyed(containers.rewrite_containers(packages(spark, sf_dir, "xlsx")), F.col("redacted_text").alias("redacted"), "message")


@query(f"SELECT key, cast(key AS varchar) AS number, '' AS formula, '<US_SSN>' AS footer, '<EMAIL_ADDRESS>' AS display, '<DOCUMENT_AUTHOR>' AS author, 'inlineStr' AS cached FROM ({_KEY})")
def xlsx_cells_footers_links(spark, sf_dir):
    found = parts(containers.rewrite_containers(packages(spark, sf_dir, "xlsx")), {
        "number": ("xl/worksheets/sheet1.xml", r'r="B1"[^>]*><(?:\w+:)?v>([^<]*)<'), "formula": ("xl/worksheets/sheet1.xml", r"<(?:\w+:)?f>([^<]*)<"), "footer": ("xl/worksheets/sheet1.xml", r"<(?:\w+:)?oddFooter[^>]*>([^<]*)<"),
        "display": ("xl/worksheets/sheet1.xml", r'display="([^"]*)"'), "author": ("xl/comments1.xml", r"author>([^<]+)<"), "cached": ("xl/worksheets/sheet1.xml", r'r="B2" t="([^"]*)"'),
    })
    plain = lambda c: F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")).alias(c)
    return _keyed(found, *[plain(c) for c in found.columns[1:]])


@query("SELECT c_custkey % 50 AS idx, array_to_string(list_slice(c, 1, 6), ', ') AS places, cast(len(c) AS bigint) AS cells FROM (SELECT c_custkey % 50 AS k, list('Sheet!A' || lpad(cast(c_custkey AS varchar), 9, '0') ORDER BY c_custkey) AS c, any_value(c_custkey) AS c_custkey FROM customer GROUP BY 1)")
def shared_string_join(spark, sf_dir):
    """Cells joined to the strings they use, as tables of their own."""
    cells = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("v"), F.concat(F.lit("Sheet!A"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("cell"))
    strings = spark.range(50).select(F.col("id").alias("idx"))
    return containers.string_places(strings, cells)


# -- PowerPoint ------------------------------------------------------------------------
@query(f"SELECT key, 'to ' || mail || chr(10) || 'page ' || key || chr(10) || 'say ' || ssn || chr(10) || mail AS text FROM (SELECT key, mail, ssn FROM ({_KEY}))")
def pptx_extract_text(spark, sf_dir):
    lines = texts(packages(spark, sf_dir, "pptx"))
    return _keyed(lines, F.array_join(F.transform(F.array(*[F.lit(x) for x in ("to ", "page ", "say ", "user")]), lambda start: F.element_at(F.filter(F.split("text", "\n"), lambda t: t.startswith(start)), 1)), "\n").alias("text"))


@query(f"SELECT key, 'EMAIL_ADDRESS in chart1' AS chart, 'DOCUMENT_AUTHOR in commentAuthors' AS authors, 'US_SSN in notesSlide1' AS notes, 'EMAIL_ADDRESS in slide1' AS slide, '1 embedded workbook(s) copied unchanged (book.xlsx)' AS unredacted, '<DOCUMENT_AUTHOR>|<DOCUMENT_AUTHOR>' AS names FROM ({_KEY})")
def pptx_rewrite_notes(spark, sf_dir):
    rows = containers.rewrite_containers(packages(spark, sf_dir, "pptx"))
    note = lambda ending: F.element_at(F.filter(F.split("message", "; "), lambda m: m.endswith(ending)), 1)
    told = rows.select("path", "content", note(" chart1").alias("chart"), note(" commentAuthors").alias("authors"), note(" notesSlide1").alias("notes"), note(" slide1").alias("slide"), F.array_join("unredacted", ",").alias("unredacted"))
    found = parts(told, {"names": ("ppt/commentAuthors.xml", r'(?:name|initials)="([^"]*)"')}, ("chart", "authors", "notes", "slide", "unredacted"))
    return _keyed(found, "chart", "authors", "notes", "slide", "unredacted", F.replace(F.replace("names", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")).alias("names"))


# -- mail ------------------------------------------------------------------------------
@query(f"""SELECT key, 'From box' || key || '@example.org Thu Jan  1 00:00:00 1970' || chr(10) || 'From: ' || mail || chr(10) || 'Received: by a for ' || mail || chr(10) || 'Received: by b for ' || mail || chr(10) || 'Subject: hello ' || key || chr(10) || 'ssn ' || ssn || chr(10) || chr(10)
 || 'From box' || key || '@example.org Thu Jan  1 00:00:00 1970' || chr(10) || 'To: ' || mail || chr(10) || 'né ' || mail || chr(10) || 'forwarded ' || ssn AS text FROM ({_KEY})""")
def mbox_extract_text(spark, sf_dir):
    return _keyed(texts(packages(spark, sf_dir, "email")), F.rtrim("text", F.lit("\n")).alias("text"))


@query(f"""SELECT key, cast(2 AS bigint) AS separators, cast(0 AS bigint) AS leaks, 'by a for <EMAIL_ADDRESS>|by b for <EMAIL_ADDRESS>' AS received, mail AS kept, 'hello ' || key || '|again' AS subjects, 'f' || key || '.bin' AS unredacted FROM ({_KEY})""")
def mbox_rewrite_headers(spark, sf_dir):
    """Every repeat of a header, forwarded messages too; other headers stay."""
    rows = containers.rewrite_containers(packages(spark, sf_dir, "email"))
    raw = F.col("content").cast("string")
    found = lambda p: F.array_join(F.regexp_extract_all(raw, F.lit(p), F.lit(1)), "|")
    leaks = F.regexp_count(F.regexp_replace(raw, "(?m)^X-Kept:.*$", ""), F.lit(r"@example|123-45-"))
    return _keyed(rows, F.regexp_count(raw, F.lit("(?m)^From ")).cast("long").alias("separators"), leaks.cast("long").alias("leaks"), found("(?m)^Received: (.*)$").alias("received"), found("(?m)^X-Kept: (.*)$").alias("kept"), found("(?m)^Subject: (.*)$").alias("subjects"), F.array_join("unredacted", "|").alias("unredacted"))


@query(f"SELECT key, cast(1 AS bigint) AS notices, cast(0 AS bigint) AS payloads, cast(1 AS bigint) AS reported, '1 attachment(s) removed (not rewritable in place)' AS message, cast(0 AS bigint) AS unredacted FROM ({_KEY})")
def mbox_attachments_stripped(spark, sf_dir):
    rows = containers.rewrite_containers(packages(spark, sf_dir, "email"), Settings(attachments="strip"))
    raw = F.col("content").cast("string")
    notice = F.base64(F.lit(containers.NOTICE).cast("binary"))
    packed = F.regexp_replace(raw, r"\s", "")
    return _keyed(
        rows, F.when(F.contains(packed, F.substring(notice, 1, 60)), 1).otherwise(0).cast("long").alias("notices"), F.regexp_count(raw, F.lit("AAEC")).cast("long").alias("payloads"),
        F.size(F.filter("entities", lambda e: e["entity_type"] == "EMAIL_ATTACHMENT")).cast("long").alias("reported"), "message", F.size("unredacted").cast("long").alias("unredacted"),
    )


# -- types and layers ------------------------------------------------------------------
@query(" UNION ALL ".join(f"SELECT c_custkey AS key, '{kind}' AS made, '{seen}' AS sniffed FROM customer" for kind, seen in (("docx", "docx"), ("xlsx", "xlsx"), ("pptx", "pptx"), ("email", "text"))))
def sniff_zip_members(spark, sf_dir):
    rows = [packages(spark, sf_dir, kind) for kind in MAKERS]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return _keyed(every, F.col("media_type").alias("made"), ingest.sniff(F.col("content"), containers.zip_members(F.col("content"))).alias("sniffed"))


_HEADS = [
    ("504b0304", "unknown"), ("255044462d312e37", "pdf"), ("5249464600000000415649204c495354", "video"), ("52494646000000005745425056503820", "image"), ("89504e470d0a1a0a", "image"), ("ffd8ffe0", "image"),
    ("474946383761", "image"), ("474946383961", "image"), ("424d00", "image"), ("68656c6c6f", "text"), ("00010203", "unknown"), ("", "unknown"),
]


@query(" UNION ALL ".join(f"SELECT r_regionkey AS key, '{h}' AS head, '{kind}' AS sniffed FROM region" for h, kind in _HEADS))
def sniff_first_bytes(spark, sf_dir):
    heads = F.explode(F.array(*[F.lit(h) for h, _ in _HEADS])).alias("head")
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), heads).select("key", "head", ingest.sniff(F.unhex("head")).alias("sniffed"))


@query(f"SELECT key, cast(9 AS bigint) AS layers_scanned, cast(3 AS bigint) AS finding_count, 'LEAKING' AS status FROM (SELECT key, 9 AS n FROM ({_KEY}))")
def verify_package_layers(spark, sf_dir):
    """Packages that were never rewritten, as finished output: every zip part, the text
    and the raw bytes are layers; a value counts once."""
    rows = verify.verify(packages(spark, sf_dir, "docx"), entities=["EMAIL_ADDRESS", "US_SSN", "PHONE_NUMBER"], layers=containers.binary_layers)
    return _keyed(rows, "layers_scanned", "finding_count", "status")


# -- spans of a model, pieces, routing by name ------------------------------------------
@query(f"""SELECT key, e.t AS entity_type, cast(e.s AS int) AS "start", cast(e.e AS int) AS "end", e.v AS text FROM (SELECT key, unnest([{{'t': 'PERSON', 's': 0, 'e': 4, 'v': 'Jane'}}, {{'t': 'EMAIL_ADDRESS', 's': 5, 'e': 5 + length(mail), 'v': mail}}, {{'t': 'US_SSN', 's': 6 + length(mail), 'e': 17 + length(mail), 'v': ssn}}]) AS e FROM ({_KEY}))""")
def union_of_detectors(spark, sf_dir):
    """A model's spans beside the recognizers': on equal spans the recognizer's label
    stays, spans under the threshold go, and no recognizer's hit is lost."""
    k = _strings(spark, sf_dir)
    span = lambda label, a, b, score, text: F.struct(F.lit(label).alias("entity_type"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(score).alias("score"), text.alias("text"))
    end = 5 + F.length("mail")
    model = F.array(span("PERSON", F.lit(0), F.lit(4), 0.8, F.lit("Jane")), span("CONTACT", F.lit(5), end, 0.99, F.col("mail")), span("FAINT", F.lit(1), F.lit(3), 0.1, F.lit("an")))
    text = F.concat_ws(" ", F.lit("Jane"), "mail", "ssn")
    rows = k.select("key", F.explode(spans.union_detect(text, model, None, 0.35)).alias("e"))
    return rows.select("key", "e.entity_type", "e.start", "e.end", "e.text")


def _strings(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    ssn = F.concat(F.lit("123-45-"), F.lpad((k % 9999 + 1).cast("string"), 4, "0"))
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("key"), F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("mail"), ssn.alias("ssn"))


@query(f"SELECT key, 'mail <EMAIL_ADDRESS>|| at | [fixed] ||<US_SSN>| end' AS pieces FROM ({_KEY})")
def rewrite_split_string(spark, sf_dir):
    """A string over several fragments: a replacement stands where its entity begins;
    what can't be edited only counts."""
    k = _strings(spark, sf_dir)
    piece = lambda text, editable=True: F.struct(F.lit(editable).alias("editable"), text.alias("text"))
    pieces = F.array(piece(F.concat(F.lit("mail "), F.substring("mail", 1, 4))), piece(F.substring(F.col("mail"), 5, 99)), piece(F.lit(" at ")), piece(F.lit(" [fixed] "), False), piece(F.lit("")), piece(F.col("ssn")), piece(F.lit(" end")))
    return k.select("key", F.array_join(spans.rewrite_pieces(pieces)["texts"], "|").alias("pieces"))


_FILES = "SELECT page_id, 'p' || page_id || ['.txt', '.pdf', '.bin'][1 + page_id % 3] AS name, ['text', 'pdf', 'unknown'][1 + page_id % 3] AS media_type FROM pages"


def _files(spark, sf_dir) -> DataFrame:
    kind = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), kind(".txt", ".pdf", ".bin")).alias("name"), kind("text", "pdf", "unknown").alias("media_type"))


@query(f"SELECT page_id, CASE WHEN media_type = 'text' THEN 'builtin' END AS backend, CASE WHEN media_type <> 'text' THEN 'backend ''builtin'' does not support ' || media_type || ' files (needed for ' || name || ')' END AS error FROM ({_FILES})")
def route_by_name(spark, sf_dir):
    return routing.route(_files(spark, sf_dir), routing.backends(spark, available={}), "builtin").select("page_id", "backend", "error")


@query(f"""SELECT page_id, 'nope' AS wanted, 'unknown backend ''nope''. Known: anonymizer, builtin, deface, ocr, pdf-redact-tools, philter, presidio, pymupdf, redactai, yolo' AS error FROM ({_FILES})
 UNION ALL SELECT page_id, 'pymupdf', CASE WHEN media_type = 'pdf' THEN 'backend ''pymupdf'' is not available: missing pymupdf' ELSE 'backend ''pymupdf'' does not support ' || media_type || ' files (needed for ' || name || ')' END FROM ({_FILES})
 UNION ALL SELECT page_id, 'auto', CASE media_type WHEN 'pdf' THEN 'no *available* backend for pdf (' || name || '); backends that could handle it: pdf-redact-tools, pymupdf, redactai — install one and retry' WHEN 'unknown' THEN 'no backend supports unknown files (' || name || ')' END FROM ({_FILES})""")
def route_messages(spark, sf_dir):
    """What a user is told where no backend takes a file."""
    docs, dimension = _files(spark, sf_dir), routing.backends(spark, available={b[0]: b[0] == "builtin" for b in routing.BACKENDS})
    rows = [routing.route(docs, dimension, name).select("page_id", F.lit(name).alias("wanted"), "error") for name in ("nope", "pymupdf", "auto")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# -- what file formats write, texts, lines for readers -----------------------------------
@query(f"SELECT key, 'a  b' AS guid, '<p14:creationId val=\"\"/>' AS creation, '<p:sldId id=\"\" r:id=\"r1\"/>' AS slide, 'xref' || chr(10) || chr(10) || 'text' AS xref, 'trailer  end' AS id FROM ({_KEY})")
def structure_is_stripped(spark, sf_dir):
    """Ids and offsets of Office and PDF files, which look like findings."""
    n = F.lpad(F.col("key").cast("string"), 10, "0")
    row = F.lpad(F.col("key").cast("string"), 8, "0")
    return _strings(spark, sf_dir).select(
        "key", spans.strip_ooxml(F.concat(F.lit("a {"), row, F.lit("-AB12-cd34-EF56-0123456789ab} b"))).alias("guid"), spans.strip_ooxml(F.concat(F.lit('<p14:creationId val="'), n, F.lit('"/>'))).alias("creation"),
        spans.strip_ooxml(F.concat(F.lit('<p:sldId id="'), n, F.lit('" r:id="r1"/>'))).alias("slide"), spans.strip_pdf(F.concat(F.lit("xref\n"), n, F.lit(" 00000 n \ntext"))).alias("xref"),
        spans.strip_pdf(F.concat(F.lit("trailer /ID [<"), row, F.lit("> <"), row, F.lit(">] end"))).alias("id"),
    )


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '\\n', chr(10), 'g') AS text FROM documents")
def decode_line_ends(spark, sf_dir):
    """Bytes with the line ends of other systems, read as text."""
    ends = F.element_at(F.array(F.lit("\r\n"), F.lit("\r"), F.lit("\n")), (F.col("doc_id") % 3 + 1).cast("int"))
    raw = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), ends).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", ingest.decode(raw).alias("text"))


@query(f"""SELECT key, CASE key % 3 WHEN 0 THEN 'ok   f' || key || '.txt: 2 entities (EMAIL_ADDRESS x1, US_SSN x1) -> out/f' || key WHEN 1 THEN 'PART f' || key || '.txt: 2 entities (EMAIL_ADDRESS x1, US_SSN x1) -> out/f' || key || ' | an attachment stays' ELSE 'FAIL f' || key || '.txt: 0 entities | unreadable' END AS line FROM ({_KEY})""")
def result_lines(spark, sf_dir):
    k, part = _strings(spark, sf_dir), F.col("key") % 3
    found = F.when(part == 2, F.array().cast(f"array<{spans.ENTITY}>")).otherwise(spans.detect(F.concat_ws(" ", "mail", "ssn")))
    rows = k.select(
        "key", F.concat(F.lit("f"), F.col("key").cast("string"), F.lit(".txt")).alias("source"), (part != 2).alias("success"), found.alias("entities"), F.when(part == 1, F.array(F.lit("a.bin"))).otherwise(F.array().cast("array<string>")).alias("unredacted"),
        F.when(part != 2, F.concat(F.lit("out/f"), F.col("key").cast("string"))).alias("output"), F.when(part == 1, "an attachment stays").when(part == 2, "unreadable").otherwise("").alias("message"),
    )
    return rows.select("key", results.summary_line().alias("line"))


@query("SELECT * FROM (VALUES ('CREDIT_CARD'), ('EMAIL_ADDRESS'), ('IBAN_CODE'), ('IP_ADDRESS'), ('PHONE_NUMBER'), ('URL'), ('US_SSN'), ('US_ZIP_CODE')) t(entity_type)")
def known_entities(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in recognizers.KNOWN_ENTITIES], "entity_type string")


# -- search ----------------------------------------------------------------------------
@query("SELECT key, array_to_string(list_slice(range(0, n, greatest(1, n // 8)), 1, 8), ',') AS frames FROM (SELECT c_custkey AS key, c_custkey % 100 AS n FROM customer)")
def video_frame_sample(spark, sf_dir):
    n = F.col("c_custkey") % 100
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.array_join(F.transform(semantic.frame_sample(n, 8), lambda x: x.cast("string")), ",").alias("frames"))


@query("SELECT count(*) AS frames, count(DISTINCT label) AS files FROM embeddings")
def index_files(spark, sf_dir):
    return semantic.index_summary(table(spark, sf_dir, "embeddings").withColumn("path", F.col("label").cast("string")))


@query(f"SELECT label, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM ({_RAW})) WHERE rn = 1 AND score >= 0.1")
def semantic_search_per_file(spark, sf_dir):
    """Files whose best frame reaches a threshold."""
    index, q, _ = _vectors(spark, sf_dir)
    return semantic.search(index, q, None, None, 0.1, "label").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text in the picture was not examined (no OCR)' WHEN 1 THEN 'text in the picture still holds EMAIL_ADDRESS, US_SSN' END AS note FROM documents")
def picture_text_note(spark, sf_dir):
    k = F.col("doc_id") % 3
    found = F.when(k == 1, F.array(F.lit("US_SSN"), F.lit("EMAIL_ADDRESS"), F.lit("US_SSN"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", backends.unexamined_note(k != 0, found).alias("note"))
