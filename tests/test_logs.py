import os

from lodestone.logs import clean_old, session_log


def test_old_logs_go(tmp_path):
    for name, age in (("a.log", 8), ("b.log", 6), ("c.txt", 9)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1e9 - age * 86_400,) * 2)
    assert clean_old(tmp_path, now=1e9) == 1 and not (tmp_path / "a.log").exists()
    session_log(str(tmp_path / "logs")).info("hello")
    assert "hello" in next((tmp_path / "logs").glob("*.log")).read_text()
