"""The command line over a small library: modes, refusals, and files that are written."""

import os
import zipfile

import pytest

from glyphmill.__main__ import locale_of, main, mode_of
from test_books import book


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "d").mkdir()
    (tmp_path / "in" / "one.epub").write_bytes(book())
    (tmp_path / "d" / "STCharacters.txt").write_text("后\t後\n里\t裡\n")
    (tmp_path / "d" / "STPhrases.txt").write_text("里里\t裏裏\n")
    return tmp_path


def test_books_are_converted_and_written(spark, folders, capsys):
    given = [str(folders / "in"), "-d", "s2t", "--dictionaries", str(folders / "d")]
    assert main([*given, "-t"], spark) == 0 and "mode: s2t;" in capsys.readouterr().out
    assert main([*given, "-v", "-od", str(folders / "out"), "-a", "_t", "-qt", "e", "-td", "v"], spark) == 0
    said = capsys.readouterr().out
    assert "to change: 1" in said and "t/a.xhtml" in said and "written: 1" in said
    assert os.listdir(folders / "out") == ["one_t.epub"]
    with zipfile.ZipFile(folders / "out" / "one_t.epub") as zf:
        assert '<html lang="zh-Hant-CN">' in zf.read("OEBPS/t/a.xhtml").decode() and "<b>裡</b>" in zf.read("OEBPS/t/a.xhtml").decode()
        assert 'page-progression-direction="rtl"' in zf.read("OEBPS/c.opf").decode() and "<dc:title>後" in zf.read("OEBPS/c.opf").decode()
    with pytest.raises(FileExistsError):
        main([*given, "-q", "-od", str(folders / "out")], spark)


def test_what_cannot_be_done(folders, capsys):
    assert main(["x", "-d", "t2s", "-il", "jp"]) == 1
    assert main(["x", "-s", "-d", "s2t", "-ol", "tw", "-p"]) == 0 and "s2twp" in capsys.readouterr().out
    for bad in (["x", "-d", "s2t", "-od", "y"], ["x", "--force-pivot"], ["x", "-d", "none"], ["x", "-d", "s2t", "-j", "--dictionaries", "d", "-od", "y"]):
        with pytest.raises(SystemExit):
            main(bad)
    assert mode_of(3, 1, 2, True) == "hk2tw" and mode_of(2, 0, 1, True) == "s2hkp" and mode_of(2, 1, 1, False) is None
    assert locale_of(1, 0, True) == "zh-cn" and locale_of(2, 1, True) == "zh-hk" and locale_of(2, 3, True) is None and locale_of(0, 0, True) is None
