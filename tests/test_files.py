import gzip
import json
import lzma
import re
import zipfile
from decimal import Decimal

import pytest
import zstandard

from mudlark import sinks, sqlscan
from mudlark.operators.regions import regions_of
from mudlark.plans import compiler, draft, fit, pile, sniff, target
from mudlark.session import Session, StaleError, fresh, load, save
from mudlark.sources import jsondoc, reader
from mudlark.sources.bytes import SourceError, compression, detect
from mudlark.spec import Extraction, ParseSpec, SpecError, Transform, dumps, from_dict, json_schema, loads


def put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(p)


TILL = "Tag;Filiale;Kasse\r\n03.02.2025;Hafen;2'050.25\r\n04.02.2025;Höhe;990.50\r\n05.02.2025;Markt;1'310.75\r\n"


def test_quick_start(spark, tmp_path):
    path = put(tmp_path, "till.csv", TILL, "cp1252")
    s = Session(spark)
    assert s.sql(f"SELECT count(*) AS n, sum(kasse) AS s FROM messy('{path}')").first().asDict() == {"n": 3, "s": Decimal("4351.50")}
    assert [c.name for c in load(path)[0].columns] == ["tag", "filiale", "kasse"] and fresh(path)
    assert {r["filiale"] for r in Session(spark, frozen=True).sql(f"SELECT filiale FROM messy('{path}')").collect()} == {"Hafen", "Höhe", "Markt"}
    put(tmp_path, "till.csv", TILL + "x", "cp1252")
    with pytest.raises(StaleError):
        Session(spark, frozen=True).table(path)


def test_errors_are_loud(spark, tmp_path):
    """A bad cell stops every query on the file, also one that doesn't read its column."""
    path = put(tmp_path, "bad.csv", "a,b\n1,x\nz,y\n")
    spec = from_dict({"transforms": [{"op": "promote_header"}], "columns": [{"name": "a", "dtype": "int64"}, {"name": "b"}]})
    save(path, spec)
    for text in ("count(*)", "b"):
        with pytest.raises(compiler.VerifyError, match="row 2.*'z'"):
            Session(spark).sql(f"SELECT {text} FROM messy('{path}')")


def test_late_surprises(spark, tmp_path):
    rows = "".join(f"{i},{'NA' if i == 901 else 1},X{i}\n" for i in range(1, 1001))
    path = put(tmp_path, "late.csv", "id,pets,town\n" + rows)
    assert Session(spark, write=False).sql(f"SELECT count(*) AS n, count(pets) AS c, sum(pets) AS s FROM messy('{path}')").first().asDict() == {"n": 1000, "c": 999, "s": 999}
    rows = "".join(f"{i},{'B7' if i == 950 else i}\n" for i in range(1, 1001))
    spec = sniff.sniff(spark, put(tmp_path, "alpha.csv", "ride,dock\n" + rows))
    assert [c.dtype for c in spec.columns] == ["int64", "utf8"] and "B7" in " ".join(spec.notes)
    rows = "".join(("bill,owed,who\n" if i == 700 else "") + f"{i},{i + 100},c{i}\n" for i in range(1, 1001))
    path = put(tmp_path, "twice.csv", "bill,owed,who\n" + rows)
    assert Session(spark, write=False).sql(f"SELECT count(*) AS n, sum(owed) AS s FROM messy('{path}')").first().asDict() == {"n": 1000, "s": 600500}


def test_torture(spark, tmp_path):
    s = Session(spark, write=False)
    path = put(tmp_path, "quoted.csv", 'id,note,amount\n1,"a, b\nc",10.50\n2,"say ""hi""",2.25\n3,,1.00\n')
    assert [r["note"] for r in s.table(path).orderBy("id").collect()] == ["a, b\nc", 'say "hi"', None]
    path = put(tmp_path, "ragged.csv", "d,m\na,10\nb\nc,25,9\n")
    spec = from_dict({"extraction": {"ragged": "pad_nulls"}, "transforms": [{"op": "promote_header"}], "columns": [{"name": "m", "dtype": "int64"}]})
    assert sorted(str(r[0]) for r in compiler.table(spark, path, spec).collect()) == ["10", "25", "None"]
    with pytest.raises(ValueError, match="row .* fields"):
        compiler.table(spark, path, from_dict({"transforms": [{"op": "promote_header"}], "columns": [{"name": "m"}]}))
    path = put(tmp_path, "total.csv", "Report 2025\n\ndatum,umsatz\n2025-01-01,10\n2025-01-02,20\n2025-01-03,30\nTotal,60\n")
    assert s.sql(f"SELECT sum(umsatz) AS s FROM messy('{path}')").first()["s"] == 60


def test_workbook_case(spark, tmp_path):
    """Titles, a header of two rows, merged cells, subtotals and a wide layout, as text."""
    lines = ["Umsatz;;;;", "Stand;;;;", "intern;;;;", ";;2025;;", "Region;Produkt;Jan;Feb;Dez", "Ost;A;1;2;3", ";B;4;5;6", "Subtotal;;5;7;9", "West;A;7;8;9", "Total;;12;15;18"]
    path = put(tmp_path, "u.csv", "\n".join(lines) + "\n")
    spec = from_dict(
        {
            "extraction": {"delimiter": ";"},
            "transforms": [
                {"op": "skip_rows", "head": 3, "tail": 1},
                {"op": "promote_header", "rows": 2},
                {"op": "drop_rows_matching", "pattern": "^Subtotal", "column": "Region"},
                {"op": "fill_down", "columns": ["Region"]},
                {"op": "unpivot", "ids": ["Region", "Produkt"], "values": ["2025 Jan", "2025 Feb", "2025 Dez"], "variable": "monat", "value": "umsatz"},
            ],
            "columns": [{"name": "region", "source": "Region"}, {"name": "monat"}, {"name": "umsatz", "dtype": "int64"}],
        }
    )
    rows = compiler.table(spark, path, spec, provenance=True).orderBy("_row").collect()
    assert len(rows) == 9 and sum(r["umsatz"] for r in rows) == 45 and [r["region"] for r in rows[3:6]] == ["Ost"] * 3 and [r["_row"] for r in rows] == list(range(1, 10))


def test_logs_and_fixed_width(spark, tmp_path):
    s = Session(spark, write=False)
    line = '10.0.0.{} - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 {} "-" "M"\n'
    path = put(tmp_path, "a.log", "".join(line.format(i, i if i else "-") for i in range(8)) + "broken\n")
    assert s.sql(f"SELECT count(*) AS n, sum(body_bytes) AS s FROM messy('{path}')").first().asDict() == {"n": 8, "s": 28}
    path = put(tmp_path, "f.txt", "".join(f"{n:<12}{c:>8}   {k:<5}\n" for n, c, k in [("Name", "Menge", "Ort"), ("Müller", "10", "ZH"), ("Meier", "200", "BE"), ("Keller", "3000", "GE")]))
    assert s.sql(f"SELECT sum(menge) AS s FROM messy('{path}')").first()["s"] == 3210


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2024-01-01T00:00:01Z INFO started", {"ts": "2024-01-01T00:00:01Z", "level": "INFO", "message": "started"}),
        ("2024-01-01 00:00:01,5 +02:00 [CRITICAL] disk: full", {"ts": "2024-01-01 00:00:01,5 +02:00", "level": "CRITICAL", "message": "disk: full"}),
        ('::1 - bob [01/Jan/2024:00:00:01 +0000] "GET /a?b=\\"c HTTP/2" 404 - "-" "agent 1" 0.013 up', {"remote_addr": "::1", "remote_user": "bob", "status": "404", "body_bytes": "-", "user_agent": "agent 1"}),
        ('h - - [x 1] "GET /" 200 17', {"status": "200", "body_bytes": "17", "request": "GET /"}),
        ("Jan  2 03:04:05 box cron[77]: done (ok)", {"host": "box", "process": "cron", "pid": "77", "message": "done (ok)"}),
        ("Jan 12 03:04:05 box kernel: [1.2] up", {"process": "kernel", "pid": None, "message": "[1.2] up"}),
        ("2024-01-01T00:00:01+0100 box sshd[9]: hello", {"host": "box", "process": "sshd", "pid": "9"}),
        ("[Mon 1 00:00] [error] bad", {"ts": "Mon 1 00:00", "level": "error", "message": "bad"}),
    ],
)
def test_log_layouts(line, want):
    pattern = sniff.detect_log([line] * 4 + ["  more of it"])
    got = re.match(pattern, line).groupdict()
    assert {k: got[k] for k in want} == want


def test_json(spark, tmp_path):
    s = Session(spark, write=False)
    path = put(tmp_path, "n.ndjson", '{"id":1,"x":12345678901234567890123,"n":{"k":1.10}}\n{"id":2,"y":"z"}\n')
    assert [r.asDict() for r in s.table(path).orderBy("id").collect()] == [{"id": 1, "n": '{"k":1.1}', "x": "12345678901234567890123", "y": None}, {"id": 2, "n": None, "x": None, "y": "z"}]
    path = put(tmp_path, "cut.ndjson", '{"id":1}\n{"id":2}\n{"id":')
    with pytest.raises(SourceError, match="last line"):
        sniff.infer(path)
    path = put(tmp_path, "doc.json.gz", gzip.compress(json.dumps({"a": [1, 2], "rows": [{"v": 1}, {"v": 2}, {"v": 3}]}).encode()))
    assert s.sql(f"SELECT sum(v) AS s FROM messy('{path}')").first()["s"] == 6
    assert s.sql(f"SELECT count(*) AS n FROM messy('{path}', '/a')").first()["n"] == 2
    assert [jsondoc.number(x) for x in ("1e3", "1.10", "0.1", "12345678901234567890123", "1.00000000000000000001")] == ["1000.0", "1.1", "0.1", "12345678901234567890123", "1.00000000000000000001"]
    for bad in ("NaN", "[1,]", '{"a":1} x', "[" * 200 + "]" * 200):
        with pytest.raises(jsondoc.JsonError):
            jsondoc.parse(bad)
    assert jsondoc.resolve(jsondoc.parse('{"a":1,"a":2}'), "/a") == "2"


def xlsx(path, rows):
    strings = sorted({c for r in rows for c in r if isinstance(c, str)})
    cells = lambda i, r: "".join(f'<c r="{chr(65 + j)}{i}" t="s"><v>{strings.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{chr(65 + j)}{i}" s="{int(isinstance(c, float))}"><v>{c}</v></c>' for j, c in enumerate(r) if c is not None)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Umsatz" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}">{cells(i, r)}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "u.xlsx")
    xlsx(path, [["Titel"], ["Datum", "Region", "Menge"], [45658.0, "Ost", 3], [45659.0, "West", 4], [45660.0, "Ost", 5], ["Total", None, 12]])
    s = Session(spark, write=False)
    assert s.sql(f"SELECT count(*) AS n, sum(menge) AS m, min(datum) AS d FROM messy('{path}')").first().asDict()["n"] == 3
    assert str(s.sql(f"SELECT min(datum) AS d FROM messy('{path}')").first()["d"]) == "2025-01-01"


def test_bytes():
    assert detect("ä".encode("utf-16-le") * 20 + "abc".encode("utf-16-le") * 20) == "utf-16-le"
    assert detect("Süd".encode("cp1252")) == "cp1252" and detect("Süd".encode()) == "utf-8"
    with pytest.raises(SourceError):
        compression(b"PK\x03\x04")
    assert compression(zstandard.compress(b"x")) == "zstd"


def test_spec(tmp_path):
    spec = from_dict({"extraction": {"delimiter": ";"}, "transforms": [{"op": "split_column", "source": "a", "into": ["x", "y"], "by": {"positions": [3]}}], "columns": [{"name": "x", "dtype": "decimal", "precision": 10, "scale": 2, "na_values": ["-"]}]})
    assert loads(dumps(spec)) == spec
    assert json_schema()["properties"]["columns"]["type"] == "array"
    for bad in (
        {"colums": []},
        {"columns": [{"name": "x"}, {"name": "x"}]},
        {"columns": [{"name": "x", "dtype": "int64", "decimal_shift": -1}]},
        {"columns": [{"name": "x", "dtype": "decimal", "precision": 39}]},
        {"columns": [{"name": "x", "dtype": "bool", "na_values": ["Ja"], "true_values": ["ja"]}]},
        {"transforms": [{"op": "promote_header"}, {"op": "transpose"}]},
        {"transforms": [{"op": "fill_down", "columns": ["a"]}, {"op": "remove_empty"}]},
        {"extraction": {"delimiter": ";;"}},
        {"extraction": {"region": [3, 3]}},
        {"extraction": {"format": "lines", "pattern": "("}},
    ):
        with pytest.raises(SpecError):
            from_dict(bad)


def test_sqlscan():
    text = "SELECT 'messy(''a'')', \"messy\" FROM messy('it''s.csv', '/x') -- messy('no')\nJOIN /* dataset('no') */ dataset('t.mud.sql') USING (k) WHERE $$messy('no')$$ = a"
    assert [(r.function, r.path, r.hint) for r in sqlscan.references(text)] == [("messy", "it's.csv", "/x"), ("dataset", "t.mud.sql", None)]
    with pytest.raises(ValueError):
        sqlscan.references("SELECT * FROM messy(path)")


TARGET = """CREATE TABLE gauges (
  day DATE NOT NULL OPTIONS (matches = ('gemessen', 'measured')),
  station TEXT NOT NULL,
  level DECIMAL(8,2) NOT NULL OPTIONS (matches = ('pegel', 'stand'))
) WITH (files = 'week-*.csv', date_order = 'dmy', provenance = 'true');"""


def week(n, head="gemessen;station;pegel", more=""):
    return head + "\n" + "".join(f"{d:02d}/{n:02d}/2024;{name};{d * n}.{d}5{more}\n" for d, name in ((1, "Brücke"), (2, "Wehr"), (3, "Mühle")))


def test_pile_of_weeks(spark, tmp_path):
    t = put(tmp_path, "gauges.mud.sql", TARGET)
    put(tmp_path, "week-1.csv", week(1), "cp1252")
    put(tmp_path, "week-2.csv", week(2, "measured;station;stand"))
    put(tmp_path, "week-3.csv", week(3, "gemessen;station;pegel;observer", ";ann"), "utf-16")
    put(tmp_path, "week-4.csv", "gemessen;station;pegel\n01/04/2024;Wehr;high\n02/04/2024;Wehr;low\n")
    put(tmp_path, "week-5.csv", week(5, "gemessen;station;pegel;Pegel", ";0.5"))
    put(tmp_path, "week-6.csv", "gemessen;pegel\n01/06/2024;1.50\n")
    report = pile.fit_pile(spark, t)
    gaps = {f.path[-10:-4]: [g.kind for g in f.gaps] for f in report.fits if f.gaps}
    assert not report.locked and gaps == {"week-4": ["Untypable"], "week-5": ["Ambiguous"], "week-6": ["NoCandidate"]}
    for n in (4, 5, 6):
        (tmp_path / f"week-{n}.csv").unlink()
    assert pile.fit_pile(spark, t).locked
    df = pile.dataset(spark, t)
    assert df.count() == 9 and df.columns == ["day", "station", "level", "_member", "_row"]
    assert df.groupBy().sum("level").first()[0] == sum(Decimal(f"{d * n}.{d}5") for n in (1, 2, 3) for d in (1, 2, 3))
    assert Session(spark).sql(f"SELECT max(_row) AS r FROM dataset('{t}')").first()["r"] == 3
    put(tmp_path, "week-7.csv", week(7))
    with pytest.raises(pile.DriftError, match="week-7.csv: added"):
        pile.dataset(spark, t)


def test_target_refusals():
    for bad in ("CREATE TABLE t (a INT)", "CREATE TABLE t (a VARCHAR(5))", "CREATE TABLE t (a DECIMAL)", "CREATE TABLE t (a TEXT PRIMARY KEY)", "CREATE TABLE t AS SELECT 1", "CREATE TABLE t (a TEXT, a TEXT)", "CREATE TABLE t (a TEXT) WITH (fils = 'x')", "CREATE TABLE t (a TIMESTAMP WITH TIME ZONE)", "CREATE TABLE t (a TEXT); SELECT 1", "CREATE TABLE t (a TEXT NOT NULL OPTIONS (if_missing = 'null'))"):
        with pytest.raises(target.TargetError):
            target.parse(bad)
    a, b = target.parse("create table t (a text) with (files='x')"), target.parse("CREATE TABLE t(\n a TEXT -- c\n) WITH (files = 'x');")
    assert a.meaning() == b.meaning() and a.meaning() != target.parse("create table t (a text) with (files='y')").meaning()


def test_dates_and_gaps():
    assert fit.date_formats(["01/02/2024", "13/02/2024"], sniff.DATES, None) == ("%d/%m/%Y", None)
    assert fit.date_formats(["01/02/2024"], sniff.DATES, None) == ("%d/%m/%Y", "%m/%d/%Y")
    assert fit.date_formats(["02/02/2024"], sniff.DATES, None)[1] is None
    assert fit.date_formats(["01/02/2024"], sniff.DATES, "mdy") == ("%m/%d/%Y", None)
    spec = ParseSpec(columns=())
    assert fit.conforms(spec, target.parse("CREATE TABLE t (a TEXT)")) == ["a: missing"]


def test_magnitudes_regions_draft(tmp_path):
    rows = [(f"m{i}", "amount", 100.0 + i, 10) for i in range(4)] + [("off", "amount", 10_500.0, 10)]
    assert [x.split(":")[0] for x in pile.odd_magnitudes(rows)] == ["off"] and not pile.odd_magnitudes(rows[:2])
    kept, dropped = regions_of([False] * 4 + [True] + [False] * 4 + [True] + [False] * 2)
    assert [(r.start, r.end) for r in kept] == [(0, 4), (5, 9)] and [(r.start, r.end) for r in dropped] == [(10, 12)]
    assert regions_of([False] * 9) == ([], [])
    a = put(tmp_path, "a.csv", "id,amount,when\n1,1.50,2024-01-01\n2,2.25,2024-01-02\n")
    b = put(tmp_path, "b.csv", "id,amount,when,more\n1,3,2024-02-01,x\n2,4,2024-02-02,y\n")
    t = target.parse(draft.draft([a, b]))
    assert [(c.name, c.dtype, c.if_missing) for c in t.columns][0] == ("id", "int64", None) and t.columns[3].if_missing == "null"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, 'b"c', True)], "id int, s string, f boolean")
    for name in ("o.csv", "o.ndjson", "o.parquet", "o.txt"):
        sinks.write(df.orderBy("id"), str(tmp_path / name))
    assert (tmp_path / "o.csv").read_text() == 'id,s,f\n1,a,\n2,"b""c",true\n'
    assert json.loads((tmp_path / "o.ndjson").read_text().splitlines()[0]) == {"id": 1, "s": "a", "f": None}
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2
    assert "| 2  |" in (tmp_path / "o.txt").read_text()
    with pytest.raises(ValueError):
        sinks.format_for("x.dat")


def test_frames_by_format():
    assert Extraction().format == "delimited" and Transform("remove_empty").args == {}


def test_footer_far_below(spark, tmp_path):
    """The last row counts as a footer however many rows are above it, and only if its label is alone in its column."""
    s = Session(spark, write=False)
    rows = "".join(f"{i};c{i};{i},50\n" for i in range(1, 3001))
    path = put(tmp_path, "long.csv", "Key;Name;Balance\n" + rows + "Total;;4503000,00\n")
    assert s.sql(f"SELECT count(*) AS n, sum(balance) AS s FROM messy('{path}')").first().asDict() == {"n": 3000, "s": Decimal("4503000.00")}
    spec = sniff.infer(put(tmp_path, "two.csv", "Key;Name;Balance\n" + rows + "Total;;1,00\n" + rows + "Total;;2,00\n"))
    assert not any(t.op == "skip_rows" for t in spec.transforms) and "row 3001 looks like a subtotal; it is kept" in spec.notes
    xlsx(str(tmp_path / "long.xlsx"), [["Key", "Menge"], *[[f"k{i}", 1] for i in range(2500)], ["Total", 2500]])
    assert s.table(str(tmp_path / "long.xlsx")).count() == 2500


def test_frame_by_all_rows(spark, tmp_path):
    """What comes after the first rows counts too: the delimiter, other widths, and a title longer than a sample."""
    spec = sniff.infer(put(tmp_path, "late.csv", "".join(f"{i}|b,c\n" for i in range(450)) + "".join(f"{i}|y{i}\n" for i in range(9000))))
    assert spec.extraction.delimiter == "|"
    rows = "".join(f"{i};x{i}\n" for i in range(3000)) + "".join(f"{i};x{i};more\n" for i in range(3000, 3100))
    assert Session(spark, write=False).table(put(tmp_path, "wide.csv", "Key;Name\n" + rows)).count() == 3100
    path = put(tmp_path, "titled.csv", "a note;\n" * 2100 + "Key;Name\n" + "".join(f"{i};x{i}\n" for i in range(4000)))
    assert sniff.infer(path).transforms[0].args == {"head": 2100, "tail": 0}


@pytest.mark.parametrize("pack", [bytes, zstandard.compress, lzma.compress])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_parts(tmp_path, monkeypatch, pack, encoding):
    """A large file's parts hold its rows, each once and numbered as in the whole, also where quoted fields span lines."""
    monkeypatch.setattr(reader, "PART_CHARS", 1600)
    text = "".join(f'{i};"ü {i}\n;""{i}"""\n' + ("\r\n" if i % 7 == 0 else "") + ("# no\n" if i % 5 == 0 else "") for i in range(1000))
    path = put(tmp_path, "p.csv", pack(text.encode(encoding)))
    e = Extraction(delimiter=";", comment="#", encoding=None if encoding.startswith("utf") else encoding)
    whole = list(reader.delimited(e, path))
    told = reader.members(path, "p", e)
    assert len(whole) == 1000 and 8 <= len(told) and (pack is bytes or len(told) <= reader.PACKED_PARTS)
    got = [b for m in json.loads(json.dumps(told)) for b in reader.MessyReader([]).rows(reader.Member(*m))]
    assert [r for b in got for r in b["cells"].to_pylist()] == whole and [n for b in got for n in b["_row"].to_pylist()] == list(range(1, 1001))
    assert len(reader.MessyReader([reader.Member(*m) for m in told]).partitions()) == len(told)
    lines = Extraction(format="lines", pattern="(?P<a>.*)", encoding=e.encoding)
    assert sum(b.num_rows for m in reader.members(path, "p", lines) for b in reader.MessyReader([]).rows(reader.Member(*m))) == sum(1 for _ in reader.text_lines(lines, path))


def test_parts_of_json(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reader, "PART_CHARS", 4000)
    objects = [{"id": i} | ({f"k{i}": "ü", "a": i} if i in (700, 1500) else {}) for i in range(2000)]
    text = "".join(json.dumps(o) + "\n" + "\n" * (i % 3) for i, o in enumerate(objects))
    path, e = put(tmp_path, "p.ndjson", text), Extraction(format="json", lines=True)
    told = reader.members(path, "p", e)
    names = ["id", "a", "k700", "k1500"]
    got = [b for m in json.loads(json.dumps(told)) for b in reader.MessyReader([]).rows(reader.Member(*m))]
    assert len(told) > 3 and [r for b in got for r in b["cells"].to_pylist()] == [[None if o.get(n) is None else str(o[n]) for n in names] for o in objects]
    df = Session(spark, write=False).table(path)
    assert df.count() == 2000 and df.filter("a IS NOT NULL").count() == 2
    for more, said in (('{"id":', "the last line, "), ('{"id":\n{"id":1}\n', "line \\d+: ")):
        with pytest.raises(SourceError, match=said):
            reader.members(put(tmp_path, "cut.ndjson", text + more), "p", e)
