from mailframe import cli
from tests.mails import SIMPLE


def test_missing_arguments_and_files_end_with_one(capsys, tmp_path):
    assert cli.main([]) == 1
    assert cli.main([str(tmp_path / "none.eml")]) == 1
    assert "file not found" in capsys.readouterr().err


def test_files_are_written_under_both_names(spark, tmp_path):
    source, other = tmp_path / "mail.x.eml", tmp_path / "other.eml"
    source.write_bytes(SIMPLE.encode())
    assert cli.main([str(source)]) == cli.main([str(source), str(other)]) == 0
    written = (tmp_path / "mail.x.anon.eml").read_text()
    assert written == other.read_text()
    assert "alice@example.com" not in written


def test_bytes_that_are_no_text_and_messages_without_a_head(spark, tmp_path):
    source = tmp_path / "mail"
    source.write_bytes(b"\xff only")
    assert cli.main([str(source)]) == 0
    assert (tmp_path / "mail.anon").read_text() == "\N{REPLACEMENT CHARACTER} only"
