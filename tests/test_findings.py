import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import findings, markdown, raster, ranges
from pagemill.sources import files


def test_log_lines_are_classified_by_the_first_pattern(spark, tmp_path):
    (tmp_path / "b.log").write_text("This is fine\nMissing character: There is no x in font\nOverfull \\hbox (1pt)\nOverfull \\hbox (1pt)\nPackage foo Error: File x not found\nCITATION k on page 1 UNDEFINED\nNo pages of output\n")
    found = findings.log_findings(files.log_lines(spark, str(tmp_path)), "line_no")
    got = [(r["severity"], r["category"]) for r in found.orderBy(*findings.finding_order()).collect()]
    assert got == [("ERROR", "fatal-error"), ("ERROR", "missing-character"), ("ERROR", "package-error"), ("ERROR", "undefined-citation"), ("WARN", "overfull-hbox"), ("WARN", "overfull-hbox")]
    assert tuple(findings.finding_counts(found).first()) == (4, 2)


def test_artifacts_commands_and_references(spark):
    lines = spark.createDataFrame([(1, r"\input{a} % \input{b}"), (2, r"\immediate\write18{rm}"), (3, "TODO math here"), (4, r"\includegraphics[width=1]{fig, x}\input{\jobname}"), (5, r"% \write18{no}"), (6, r"\addbibresource{r.bib}"), (7, r"\bibliography{m, n}")], "line_no int, line string")
    assert [r["line_no"] for r in findings.artifact_lines(lines).collect()] == [3]
    assert sorted((r["line_no"], r["shell_escape"], r["complex_build"]) for r in findings.source_checks(lines).collect()) == [(2, True, False), (6, False, True), (7, False, True)]
    assert sorted((r["command"], r["value"]) for r in findings.references(lines).collect()) == [("addbibresource", "r.bib"), ("bibliography", "m"), ("bibliography", "n"), ("includegraphics", "fig, x"), ("input", "a")]


def test_dependencies(spark):
    lines = spark.createDataFrame([("INPUT /usr/share/a.sty",), ("INPUT ./main.tex",), ("INPUT /tmp/x",), ("OUTPUT main.pdf",), ("INPUT ",), ("INPUT main.tex",), ("INPUT /usr/share/../../etc/p",)], "line string")
    paths = files.recorder_paths(lines, "/proj").where("kind = 'INPUT'")
    roots = [("project", "/proj"), ("system", "/usr/share/")]
    by_case = {r["path"]: r["category"] for r in findings.dependency_categories(paths, roots).collect()}
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(roots)], "priority int, category string, folder string")
    assert by_case == {r["path"]: r["category"] for r in findings.dependency_categories_by_table(paths, table).collect()}
    assert by_case == {"/usr/share/a.sty": "system", "/proj/main.tex": "project", "/tmp/x": "external", "/usr/share/../../etc/p": "external"}
    report = findings.dependency_report(findings.dependency_categories(paths, roots), ["project", "system", "external", "none"])
    assert {r["category"]: r["paths"] for r in report.collect()} == {"project": 1, "system": 1, "external": 2, "none": 0}


def test_auxiliary_inputs(spark):
    lines = spark.createDataFrame([("/p/a.blg", "The style file: plain.bst"), ("/p/a.blg", "Database file #1: refs.bib"), ("/p/b.blg", "INFO - Found BibTeX data source 'x.bib'"), ("/p/b.blg", "Scanning style file /sys/y.ist..."), ("/p/b.blg", "nothing")], "path string, line string")
    got = files.auxiliary_inputs(lines)
    assert sorted(r["value"] for r in got.collect()) == ["/sys/y.ist", "plain.bst", "refs.bib", "x.bib"]
    there = spark.createDataFrame([("/p/plain.bst",), ("/proj/refs.bib",)], "path string")
    assert sorted(r["resolved"] for r in files.resolve_inputs(got, there, "/proj").collect()) == ["/p/plain.bst", "/proj/refs.bib", "/proj/x.bib", "/sys/y.ist"]


def test_stages(spark):
    rows = [("a", 1, "PASS"), ("a", 2, "INCOMPLETE"), ("a", 3, "FAIL"), ("a", 4, "PASS"), ("b", 1, "INCOMPLETE"), ("b", 2, "PASS"), ("c", 1, "PASS")]
    got = findings.reduce_stages(spark.createDataFrame(rows, "run string, stage_no int, status string"), ["run"]).collect()
    assert sorted((r["run"], r["stages_run"], r["failed_at"], r["exit_code"]) for r in got) == [("a", 3, 3, 1), ("b", 2, None, 2), ("c", 1, None, 0)]


def test_rasters(spark, tmp_path):
    images = {"a.pgm": b"P2\n# c\n2 2\n255\n0 0 9 # x\n255\n", "b.pgm": b"P5 2 1 255\n\x00\xff", "c.pgm": b"P5\n1 2\n300\r\n\x01\x00\x00\x02", "d.pgm": b"P5 9 9 255\n\x00", "e.pgm": b"P6 1 1 255\n\x00", "f.pgm": b"P2 1 1 0\n0"}
    for name, data in images.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-5:]: (r["samples"], r["maximum"], r["error"]) for r in files.read_rasters(spark, str(tmp_path)).collect()}
    assert got["a.pgm"] == ([0, 0, 9, 255], 255, None) and got["b.pgm"] == ([0, 255], 255, None) and got["c.pgm"] == ([256, 2], 300, None)
    assert (got["d.pgm"][2], got["e.pgm"][2], got["f.pgm"][2]) == ("truncated", "header", "dimensions")
    cover = raster.pixel_coverage(spark.createDataFrame([(1, [5, 1, 5, 1, 9]), (2, [7, 7]), (3, [])], "id int, samples array<int>"), "id", maximum=255)
    assert sorted(tuple(r) for r in cover.collect()) == [(1, 5, 0.6), (2, 7, 0.0)]


STATE = """Status: stray
Operation: convert
Operation: again
## Gates
### Gate: one
Status: reviewed
Reason: x
Status: twice
```
### Gate: fenced
Status: blocked
````
    ### Gate: indented
<!-- ### Gate: hidden
Status: blocked
-->
~~~
```
~~~ 
### Gate: `two`
Next action: go `<!--` on
## Other
Status: outside
Note: y
"""


def test_markdown(spark):
    lines = markdown.markdown_lines(spark.createDataFrame([("s.md", STATE), ("t.md", "a `open\n"), ("u.md", None)], "path string, text string"))
    got = sorted((r["path"], r["heading"].strip(), r["status"], r["reason"], r["next_action"]) for r in markdown.records(lines).collect())
    assert [g[:4] for g in got] == [("s.md", "Gate:", None, None), ("s.md", "Gate: one", "reviewed", "x")]
    assert got[0][4].startswith("go")
    bad = sorted((r["path"], r["rule_id"], r["label"]) for r in markdown.record_parse_violations(lines).collect())
    assert bad == [("s.md", "repeated-field", "Status"), ("s.md", "status-outside-record", "Status"), ("s.md", "status-outside-record", "Status"), ("t.md", "open-code-span", "")]
    meta = {r["label"]: (r["value"], r["times"]) for r in markdown.metadata(lines, ["Operation", "Status", "Note"]).collect()}
    assert meta == {"Operation": ("convert", 2), "Status": ("stray", 1)}


def test_frontmatter_and_resources(spark):
    docs = spark.createDataFrame([("a.md", "---\nname: x\ndescription: \"y z\"\n---\nsee refs/a.md and refs/a.md, assets/t/b.json.\n")], "path string, text string")
    assert sorted((r["key"], r["value"]) for r in markdown.frontmatter(docs).collect()) == [("description", "y z"), ("name", "x")]
    assert sorted(r["resource"] for r in markdown.resource_references(docs, ["refs", "assets"]).collect()) == ["assets/t/b.json", "refs/a.md"]


@pytest.mark.parametrize(("line", "want"), [("a % b", "a "), (r"5\% % c", r"5\% "), (r"\\% c", r"\\"), ("none", "none"), ("%", "")])
def test_comment_strip(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(tx.strip_tex_comment(F.col("l"))).first()[0] == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.strip(F.lit("  x  \n"))) == "x" and one(tx.indent_columns(F.lit(" \t  x"))) == 6
    assert one(tx.version_parts(F.lit("3.10.2")) > tx.version_parts(F.lit("3.9"))) is True
    assert one(tx.page_file_name(F.lit(7), "png")) == "page-007.png" and one(tx.page_file_name(F.lit(1234), "txt")) == "page-1234.txt"
    assert one(tx.fill_template(F.lit("{{A}} {{B}}"), F.create_map(F.lit("A"), F.lit("1")))) == "1 {{B}}"
    assert one(tx.unknown_placeholders(F.lit("{{A}} {{B}}"), F.create_map(F.lit("A"), F.lit("1")))) == ["B"]
    assert one(tx.expand_braces(F.lit("!!/a/{x,y}//:/b:"))) == ["/a/x", "/a/y", "/b"]
    assert one(tx.lines(F.lit("a\r\nb c\n"))) == ["a", "b", "c"] and one(tx.suffix(F.lit("x/A.TeX"))) == ".tex"
    assert one(tx.ratio(F.lit(1), F.lit(3))) == 0.3333 and one(tx.ratio(F.lit(1), F.lit(0))) == 0.0


def test_tail(spark):
    rows = spark.createDataFrame([(k, i) for k in "ab" for i in range(30)], "k string, i int")
    assert sorted((r["k"], r["i"]) for r in ranges.tail(rows, ["k"], "i", 2, chunk=7).collect()) == [("a", 28), ("a", 29), ("b", 28), ("b", 29)]


def test_source_files_and_identity(spark, tmp_path):
    for name, data in {"main.tex": b"x", "logs/a.tex": b"x", "sub/b.TIKZ": b"\x00", "c.png": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.source_files(spark, str(tmp_path))
    assert sorted(r["relative"] for r in got.collect()) == ["main.tex", "sub/b.TIKZ"]
    assert [r["relative"] for r in findings.text_files(got).collect()] == ["main.tex"]
    (tmp_path / "d.pdf").write_bytes(b"junk%PDF-1.4")
    r = files.source_identities(spark, str(tmp_path / "d.pdf")).first()
    assert r["is_pdf"] and r["size_bytes"] == 12
    (tmp_path / "page-001.txt").write_text("hi")
    assert tuple(files.page_files(spark, str(tmp_path / "page-001.txt")).first()) == ("page-001.txt", 1, "hi", False)


def test_contract_rules(spark):
    paths, gates = files.read_rules(spark, '{"path_rules": [{"id": "a", "when": {"traits_any": ["book"]}, "require_files": ["x"]}], "gate_rules": []}')
    assert paths.first()["required"] == ["x"] and gates.count() == 0


def by_lines(text):
    """The lines that count, one line after another."""
    import re

    out, fence, comment, ticks = [], None, False, 0
    for no, line in enumerate(text.splitlines(), 1):
        if fence:
            if re.fullmatch(rf" {{0,3}}{fence[0]}{{{len(fence)},}}[ \t]*", line):
                fence = None
            continue
        if not comment and not ticks:
            if re.match(" {0,3}\\t| {4}", line):
                continue
            if start := re.match(" {0,3}(```+|~~~+)", line):
                fence = start[1]
                continue
        shown = ""
        while line:
            if comment:
                comment = "-->" not in line
                line = "" if comment else line.split("-->", 1)[1]
            elif run := re.match("`+", line):
                ticks = 0 if ticks == len(run[0]) else ticks or len(run[0])
                shown, line = shown + " " * len(run[0]), line[len(run[0]) :]
            elif not ticks and line.startswith("<!--"):
                comment, line = True, line[4:]
            else:
                shown, line = shown + (" " if ticks else line[0]), line[1:]
        if re.match(" {0,3}\\t| {4}", shown):
            continue
        if start := re.match(" {0,3}(```+|~~~+)", shown):
            fence = start[1]
            continue
        out.append((no, shown))
    return out + [(0, "")] * bool(ticks)


def test_markdown_scanner_against_line_by_line():
    import random

    rng = random.Random(3)
    signs = ["`", "``", "```", "````", "<!--", "-->", " ", "    ", "\t", "\n", "\n", "\n", "a", "### x", "Status: b", "-", "é", "\r\n"]
    for _ in range(20000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 16)))
        assert list(markdown.active_lines(text)) == by_lines(text), text
    for _ in range(20000):
        text = "".join(rng.choice(["~~~", "~~~~", "~", "`", "\n", "\n", " ", "a", "    ", "<!--", "-->"]) for _ in range(rng.randint(0, 12)))
        assert list(markdown.active_lines(text)) == by_lines(text), text


def test_markdown_fence_behind_a_comment():
    assert list(markdown.active_lines("<!-- x --> ~~~ a\n### no\n~~~\n### yes")) == [(4, "### yes")]
    # the span that the fence's line opens is still open behind the fence
    assert list(markdown.active_lines("<!-- x --> ~~~ `a\n~~~\nn` yes")) == [(3, "   yes")]
