"""Books from files to new files: text, metadata, contents, styles, resources, labels and reports."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import package as P
from glyphmill.functions import styles as S
from glyphmill.functions.markup import Markup, annotate, rewriter, tokens, without_annotations
from glyphmill.functions.notes import numbered_marker, own_comments, with_note
from glyphmill.operators import books as B
from glyphmill.plans import decisions as D
from glyphmill.plans.program import Dictionary, Program, without_tofu
from glyphmill.sources import epub

P1 = Program("p", ((Dictionary.of("d", {"后": "後", "里": "裡", "软件": "軟體程式"}),),))
OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title>后</dc:title><dc:creator id="里" opf:file-as="里, A" role="aut">里 &amp; B</dc:creator><dc:language>zh-CN</dc:language><dc:identifier>后</dc:identifier></metadata>
<manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="s" href="s.css" media-type="text/css"/><item id="i" href="i/p 1.png" media-type="image/png"/>
<item id="f" href="f.ttf" media-type="application/x-font-ttf"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n"><itemref idref="a"/></spine></package>"""
HTML = """<html lang="zh-CN"><head><title>里</title><style>@font-face{font-family:"宋体 X";src:url(../../f.ttf)} p{font-family:里}</style></head>
<body><p>后 &amp 里<b>里</b></p><img src="../i/p%201.png" alt="x"/><a href="../f.ttf">里</a></body></html>"""
NCX = "<ncx><navMap><navPoint><navLabel><text>后</text></navLabel><content src='t/a.xhtml'/></navPoint></navMap></ncx>"
CSS = "/* c */ body.calibre-chinese_text { color: red; writing-mode: x }\np{font-family: 'Kai', serif}\n@font-face { font-family: Emb; src: url('f.ttf') }"


def book(**more):
    held = io.BytesIO()
    names = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>',
             "OEBPS/c.opf": OPF, "OEBPS/t/a.xhtml": HTML, "OEBPS/s.css": CSS, "OEBPS/i/p 1.png": "png", "OEBPS/f.ttf": "ttf", "OEBPS/toc.ncx": NCX} | more
    with zipfile.ZipFile(held, "w") as zf:
        for n, x in names.items():
            zf.writestr(n, x)
    return held.getvalue()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "one.epub").write_bytes(book())
    (folder / "Two.EPUB").write_bytes(book(**{"OEBPS/t/a.xhtml": "<p>plain</p>"}))
    (folder / "broken.epub").write_bytes(b"no zip")
    (folder / "other.txt").write_bytes(b"x")
    found = epub.read_books(spark, str(folder))
    assert found.count() == 3
    return epub.parts(found).withColumn("book", F.substring_index("book", "/", -1)).cache()


def contents(df, name="one.epub"):
    return {r["part_name"]: bytes(r["content"]).decode() for r in df.filter(F.col("book") == name).collect()}


def test_parts_and_their_kinds(parts):
    kinds = {r["part_name"]: r["mime"] for r in parts.filter("book = 'one.epub'").collect()}
    assert kinds["OEBPS/t/a.xhtml"] == "application/xhtml+xml" and kinds["OEBPS/f.ttf"] == "application/x-font-ttf" and len(kinds) == 8
    assert epub.text_parts(parts).count() == 2 and epub.style_parts(parts).count() == 2 and epub.image_parts(parts).count() == 2


def test_a_book_is_converted_part_by_part(parts):
    out = B.convert_books(parts, B.BookOptions(Markup(P1, language="zh-Hant-TW")))
    found = contents(out)
    assert '<html lang="zh-Hant-TW">' in found["OEBPS/t/a.xhtml"] and "<p>後 &amp; 裡<b>裡</b></p>" in found["OEBPS/t/a.xhtml"] and "font-family:里" in found["OEBPS/t/a.xhtml"]
    opf = found["OEBPS/c.opf"]
    assert "<dc:title>後</dc:title>" in opf and 'file-as="裡, A"' in opf and 'id="里"' in opf and ">裡 &amp; B<" in opf and "<dc:language>zh-Hant-TW<" in opf and "<dc:identifier>后<" in opf
    assert "<text>後</text>" in found["OEBPS/toc.ncx"] and found["OEBPS/s.css"] == CSS
    assert {r["book"] for r in B.changed_books(out, parts).collect()} == {"one.epub", "Two.EPUB"}
    (shown,) = B.book_previews(out).filter("book = 'one.epub'").collect()
    assert shown["part_name"] == "OEBPS/t/a.xhtml" and shown["preview"].startswith("後")


def test_fonts_images_direction_and_policy(parts):
    out = contents(B.convert_books(parts, B.BookOptions(Markup(P1, orientation=2), fonts="serif", locale=2, strip_fonts=True, strip_images=True)))
    assert "OEBPS/f.ttf" not in out and "OEBPS/i/p 1.png" not in out
    assert "<img" not in out["OEBPS/t/a.xhtml"] and "<a href" not in out["OEBPS/t/a.xhtml"] and "裡</body>" in out["OEBPS/t/a.xhtml"] and "@font-face" not in out["OEBPS/t/a.xhtml"]
    assert 'class="calibre-chinese_text"' in out["OEBPS/t/a.xhtml"] and '"Noto Serif CJK TC", "Noto Serif CJK HK"' in out["OEBPS/t/a.xhtml"]
    assert "@font-face" not in out["OEBPS/s.css"] and "color:red" in out["OEBPS/s.css"] and "writing-mode:vertical-rl" in out["OEBPS/s.css"] and out["OEBPS/s.css"].count("body.calibre-chinese_text {") == 1
    assert 'page-progression-direction="rtl"' in out["OEBPS/c.opf"] and 'href="f.ttf"' not in out["OEBPS/c.opf"] and 'href="s.css"' in out["OEBPS/c.opf"]
    part = contents(B.convert_books(parts, B.BookOptions(Markup(P1, source="file"), strip_images=True)))
    assert "OEBPS/i/p 1.png" in part


def test_books_are_written_anew(parts, tmp_path, spark):
    out = B.convert_books(parts, B.BookOptions(Markup(P1)))
    assert epub.write_books(out, str(tmp_path / "dry"), dry_run=True).count() == 2 and not (tmp_path / "dry").exists()
    made = epub.write_books(out, str(tmp_path / "new"), out.filter("book = 'one.epub'"))
    assert [r["book"] for r in made.collect()] == ["one.epub"]
    data = spark.read.parquet(str(tmp_path / "new")).first()["data"]
    with zipfile.ZipFile(io.BytesIO(data)) as zf:
        assert zf.namelist()[0] == "mimetype" and zf.infolist()[0].compress_type == zipfile.ZIP_STORED and "後" in zf.read("OEBPS/c.opf").decode()
    with pytest.raises(Exception):
        epub.write_books(out, str(tmp_path / "new"))


def test_images_fonts_and_labels(parts, spark):
    (ref,) = B.image_references(parts).filter("book = 'one.epub'").collect()
    assert ref["image"] == "OEBPS/i/p 1.png"
    texts = spark.createDataFrame([("one.epub", "OEBPS/i/p 1.png", 'a "b"')], "book string, image string, text string")
    assert 'alt="a &quot;b&quot;"/>' in contents(B.label_images(parts, texts))["OEBPS/t/a.xhtml"]
    assert P.with_label("<image href='x'>", "t") == "<image href='x' aria-label=\"t\">" and P.with_label("<img src=x>", "t") == '<img src=x alt="t">'
    found = {r["book"]: r for r in B.font_report(parts).collect()}
    assert found["one.epub"]["families"] == ["Emb", "Kai", "宋体 X", "里"] and found["one.epub"]["embedded"] == ["Emb", "宋体 X"] and found["one.epub"]["simplified"]
    t, f = F.lit(True), F.lit(False)
    assert {r["units"] for r in B.work_units(parts, t, t, F.lit(1), t, f, f).collect()} == {5}


def test_tokens_give_the_page_back():
    page = "<!DOCTYPE html><a b='>'>x&amp;y & z<script>if (a<b) '</p>'</script ><!-- c --><?pi x?><br/></A>　<"
    assert "".join(t[2] for t in tokens(page)) == page
    assert [t[0] for t in tokens(page)][:6] == ["declaration", "start", "text", "entity", "text", "text"]
    assert rewriter(Markup(P1))("<P>后&lt里</P><SCRIPT>后</SCRIPT>") == "<P>後&lt;裡</p><SCRIPT>后</script>"


def test_selections_and_styles_of_text():
    m = Markup(P1, source="selection", quotes=2)
    assert rewriter(m)("后<!--PI_SELTEXT_START-->后“里”<!-- PI_SELTEXT_END -->后“”") == "后<!--PI_SELTEXT_START-->後「裡」<!-- PI_SELTEXT_END -->后“”"
    down = Markup(quotes=2, orientation=2, punctuation=True, omits="")
    assert rewriter(down)("<body class='a'>“x”（，</body>") == "<body class='a calibre-chinese_text'>﹁x﹂︵︐</body>"
    up = Markup(quotes=1, orientation=1, punctuation=True, omits="")
    assert rewriter(up)("<body>﹁x﹂</body>") == '<body class="calibre-chinese_text">“x”</body>'


def test_annotated_text():
    spans = [(0, 1, "后", "後"), (1, 2, "x", "x"), (2, 4, "软件", "軟體程式")]
    full, changed = annotate("后x软件", "後x軟體程式", spans), annotate("后x软件", "後x軟體程式", spans, "changed")
    assert full.count("<ruby") == 2 and changed.count("<ruby") == 1 and full.count("ctc-bi-pair") == changed.count("ctc-bi-pair") == 1
    assert without_annotations(full) == without_annotations(changed) == "后x软件"
    assert annotate("a&b", "a&b") == "a&b" and "&amp;" in annotate("后&", "後&") and annotate("后里", "後裡", [(0, 1, "x", "後")]).count("<ruby") == 1
    page = "<head></head><body><p>后x软件</p></body>"
    once = rewriter(Markup(P1, annotation="full"))(page)
    assert "ctc-bi-annotation-style" in once and without_annotations(once) == page.replace("<body>", '<body class="calibre-chinese_text">')
    assert rewriter(Markup(P1, annotation="full"))(once) == once


def test_rules_of_style_sheets():
    assert S.with_rule("a{b:c}", "x, y", "d:e") == "a{b:c}\nx, y{d:e}\n"
    again = S.with_rule(S.with_rule("a{b:c}", "x, y", "d:e"), "x,y", "d: e;")
    assert again == S.with_rule("a{b:c}", "x, y", "d:e") and S.with_rule(again, "x,y", "f:g").endswith("x, y{f:g}\n")
    once = S.with_annotation_rules("p{}")
    assert S.with_annotation_rules(once) == once and once.count("ctc-bi-pair>.ctc-bi-main") == 1
    assert S.font_stack("keep") == "" and S.font_stack("sans", 0, "mac").startswith('"PingFang SC", "Heiti SC", "PingFang TC"') and S.font_stack("serif").endswith(", serif")
    assert S.with_direction("", 1).count("horizontal-tb") == 3 and S.with_direction("p{}", 1, add=False) == "p{}"
    assert 'content="vertical-rl"' in P.with_writing_mode("<metadata><x/></metadata>", 2) and P.with_writing_mode(P.with_writing_mode("<metadata/></metadata>", 2), 1).count("<meta ") == 1


def test_comments_and_sections(spark):
    text = "Mine.\n\n----\nConverted by Chinese Conversion\n\nplugin info: 转换信息\n\n----\n<p>for calibre</p>\n\nKept.<hr/>---"
    assert own_comments(text) == "Mine.\n\nKept." and own_comments("") == "" and own_comments("a\n\nb") == "a\n\nb"
    df = spark.createDataFrame([(1, text, "----Book info begin----"), (2, None, "x")], "id int, c string, m string")
    rows = df.select(with_note(F.col("c"), F.lit("note")).alias("c"), numbered_marker(F.col("m"), F.lit(1), F.lit(5)).alias("m")).collect()
    assert [r["c"] for r in rows] == ["Mine.\n\nKept.\n----\nnote", "note"] and rows[0]["m"] == "---- (1/5) Book info begin ----"
    sections = spark.createDataFrame([(1, 1, "----a----", ["x", "", None], "----b----"), (1, 2, "c", None, "d")], "book int, step int, begin string, lines array<string>, end string")
    assert [r["line"] for r in B.log_sections(sections).orderBy("step", "line_no").collect()] == ["---- (1/2) a ----", "x", "---- (1/2) b ----", "---- (2/2) c ----", "---- (2/2) d ----"]


def test_summaries_and_library_rows(spark):
    stats = spark.createDataFrame([(1, 2, 1, 0, "no_image_resources", ["a", " "], ["i"]), (2, 1, 0, 1, "ocr_no_delta", ["b", "c", "d"], ["i", "j"])], "book int, images_recognized int, text_results int, recognized_no_change int, reason string, sample_results array<string>, recognized_images array<string>")
    (row,) = B.recognition_summary(stats).collect()
    assert (row["images_recognized"], row["reason"], row["sample_results"], row["recognized_images"]) == (3, "ocr_no_delta", ["a", "b", "c"], ["i", "j"])
    results = spark.createDataFrame([(1, "t1", "created", 10, 3, 1.0, 5.0), (2, "t2", "failed", 0, 0, 1.0, 5.0)], "book int, title string, state string, chars long, converted long, elapsed double, wall double")
    (row,) = B.batch_summary(results).collect()
    assert tuple(row) == (10, 3, 5.0, ["t1"], [], ["t2"])
    library = spark.createDataFrame([(1, "后_简体中文_ab12", ["里"], "后", {"AZW3": "/a"}), (2, None, None, None, {"PDF": "/p"})], "book_id int, title string, tags array<string>, comments string, formats map<string,string>")
    rows = {r["book_id"]: r for r in B.imported(library, P1, F.lit("_繁体中文_x"), F.lit("n"), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert rows[1]["title"] == "後_繁体中文_x" and rows[1]["tags"] == ["裡"] and rows[1]["comments"] == "後\n----\nn" and rows[2]["comments"] == "n" and rows[2]["title"] is None
    assert [(r["book_id"], r["fmt"]) for r in epub.first_formats(library).collect()] == [(1, "AZW3")]
    assert [r["book_id"] for r in B.without_skipped(library, library.filter("book_id = 1")).collect()] == [2]


def test_decisions(spark):
    rows = [("zh_TW", 1, 2, 0, 1), ("zh-HK", 3, 1, 2, 2), ("zh_Hant", 2, 0, 2, 2), ("zh_CN", 0, 0, 1, 2), ("fr", 0, 3, 3, 0), (None, 2, 0, 0, 0)]
    df = spark.createDataFrame(rows, "code string, k int, s int, t int, o int")
    k, s, t, o = (F.col(c) for c in "ksto")
    lang = D.interface_language(F.col("code"))
    found = df.select(lang.alias("l"), D.suggested_quotes(k, s, t, o).alias("q"), D.suggested_punctuation(k, s, t, o).alias("p"), D.default_kind(lang).alias("dk"), D.default_orientation(lang).alias("do"), D.default_locales(lang, k).alias("dl"), D.recognized_languages(s).alias("r"), D.direction_label(k, s, t).alias("label"), D.message(F.lit("Hi"), lang, {"Hi": {"zh_cn": "你好"}}).alias("m")).collect()
    assert [r["l"] for r in found] == ["zh_tw", "zh_hk", "zh_tw", "zh_cn", "en", "en"]
    assert [(r["q"], r["p"]) for r in found] == [(1, True), (0, False), (2, True), (2, True), (0, False), (2, False)]
    assert [(r["dk"], r["do"]) for r in found] == [(2, 2), (2, 1), (2, 2), (1, 1), (None, None), (None, None)]
    assert [tuple(r["dl"]) for r in found] == [(2, 0), (1, 2), (0, 2), (-1, -1), (-1, -1), (0, 2)]
    assert found[4]["r"][0] == "ja-JP" and found[0]["label"] == "Traditional to Simplified: Taiwan → Mainland" and found[3]["label"] == "No Change" and [r["m"] for r in found][3:5] == ["你好", "Hi"]


def test_configurations_without_what_may_be_missing():
    config = {"conversion_chain": [{"dict": {"type": "group", "dicts": [{"type": "ocd2", "file": "A.ocd2"}, {"type": "ocd2", "file": "B.ocd2", "may_output_tofu": True}]}}]}
    assert without_tofu(config) == {"conversion_chain": [{"dict": {"type": "group", "dicts": [{"type": "txt", "file": "A.txt"}]}}]}
