import json
import threading

from scriptorium import cli
from scriptorium.operators import runlog


def test_commands(spark, tmp_path, capsys):
    def run(*argv):
        code = cli.main(list(argv))
        out, rows, at = capsys.readouterr().out, [], 0
        while at < len(out.rstrip()):
            value, at = json.JSONDecoder().raw_decode(out, at)
            rows.append(value)
            while at < len(out) and out[at].isspace():
                at += 1
        return code, rows

    lib = tmp_path / "lib"
    lib.mkdir()
    for name, text in (("a.txt", "alpha beta"), ("b.txt", "alpha  beta"), ("c.md", "gamma")):
        (lib / name).write_text(text)
    table = str(tmp_path / "t")
    assert run("refresh", "--roots", str(lib), "--table", table)[1][0][0]["new"] == 3
    code, (hits,) = run("search", "--table", table, "--query", "alpha")
    assert code == 0 and [(h["title"], h["snippet"], h["duplicate_count"], h["duplicate_paths"], h["source_available"]) for h in hits] == [("a.txt", "[alpha] beta", 2, ["a.txt", "b.txt"], True)]
    assert run("search", "--table", table, "--query", "nothing") == (1, [[]])
    assert run("search", "--table", table, "--query", "alpha", "--timeout", "0.0001")[0] in (0, 1)
    (lib / "d.txt").write_text("delta")
    again = run("refresh", "--roots", str(lib), "--table", table)[1][0][0]
    assert (again["new"], again["skipped"]) == (1, 3)
    assert run("search", "--table", table, "--query", "delta")[0] == 0 and run("search", "--table", table, "--query", "gamma")[0] == 0
    (lib / "c.md").write_text("epsilon now")
    (lib / "d.txt").unlink()
    last = run("refresh", "--roots", f"{lib}|{tmp_path}/gone", "--table", table)[1][0][0]
    assert (last["changed"], last["deleted"], last["skipped"]) == (1, 1, 2)
    assert [run("search", "--table", table, "--query", q)[0] for q in ("delta", "gamma", "epsilon", "beta")] == [1, 1, 0, 0]
    # A root that is away keeps its rows, and its hits are known to be away.
    lib.rename(tmp_path / "away")
    assert run("refresh", "--roots", str(lib), "--table", table)[1][0][0]["kept"] == 3
    assert [h["source_available"] for h in run("search", "--table", table, "--query", "epsilon")[1][0]] == [False]
    (tmp_path / "away").rename(lib)
    (lib / "d.txt").write_text("delta")
    assert run("health", "--roots", f"{lib}|{tmp_path}/gone", "--table", table)[1][0] == {"roots": {str(lib): True, f"{tmp_path}/gone": False}, "documents": 3, "with_text": 3}
    assert run("grep", "alpha", str(tmp_path), "--suffix", ".txt", "--folder", "lib")[0] == 0 and run("grep", "alpha", str(tmp_path), "--suffix", ".txt", "--folder", "none")[0] == 1
    assert {r["grouping"] for r in run("duplicates", "--table", table)[1][0]} >= {"text_hash"}
    note = tmp_path / "n.md"
    note.write_text("see MN118.150\n")
    assert run("check-shape", str(note))[0] == 1 and run("validate-note", str(note), "--tool-url", "u")[0] == 1
    assert run("grep", "alpha", str(lib), "--suffix", ".txt")[1][0][0]["line"] == 1
    info = str(tmp_path / "info")
    spark.createDataFrame([("MN", "MN60", None, "MN60", None, None, "s0202m.mul.xml", "92", "x")], "book_code string, sc_code string, cst_code string, dpd_code string, dpr_code string, bjt_sutta_code string, cst_file string, cst_paranum string, cst_sutta string").write.parquet(info)
    assert run("verify-citation", "--dictionary", info, "MN60")[0] == 0 and run("verify-citation", "--dictionary", info, "Snp 437")[0] == 2 and run("verify-citation", "--dictionary", info, "MN99")[0] == 1


def test_log_commands(spark, tmp_path, capsys):
    log = str(tmp_path / "log")
    (tmp_path / "a.txt").write_text("alpha\nbeta alpha\n")

    def run(*argv):
        code = cli.main(list(argv))
        return code, capsys.readouterr().out

    head = [f"{f}=x" for f in runlog.HEADER_FIELDS]
    assert run("log-start", "--log", log, "--run-name", "2024-01-02-r", *head)[0] == 0
    assert run("log-start", "--log", log, "--run-name", "2024-01-02-r", *head)[0] == 0
    assert run("gate", "--log", log, "--run-name", "2024-01-02-r", "1")[0] == 1  # no evidence yet
    code, _ = run("--into-log", log, "--into-run", "2024-01-02-r", "--into-phase", "1", "grep", "alpha", str(tmp_path), "--suffix", ".txt")
    assert code == 0
    assert run("gate", "--log", log, "--run-name", "2024-01-02-r", "1")[0] == 0 and run("gate", "--log", log, "--run-name", "2024-01-02-r", "1")[0] == 0
    assert run("log", "--log", log, "--run-name", "2024-01-02-r", "--phase", "2", "found it")[0] == 0
    assert run("gate", "--log", log, "--run-name", "2024-01-02-r", "3")[0] == 1
    assert run("which", "--log", log, "r")[0] == 0 and run("which", "--log", log, "z")[0] == 1
    assert run("self-audit", "--log", log, "--run-name", "2024-01-02-r", *"abcdef")[0] == 0 and run("self-audit", "--log", log, "--run-name", "2024-01-02-r", "a")[0] == 0
    assert run("verify", "--log", log, "--run-name", "2024-01-02-r")[0] == 1 and run("resume", "--log", log)[0] == 0
    rows = [(r.seq, r.phase, r.kind, r.tool, r.hits) for r in runlog.stored(spark, log).orderBy("seq").collect()]
    assert rows[:6] == [(1, "0", "header", runlog.HEADER_FIELDS[0], None), (2, "0", "header", runlog.HEADER_FIELDS[1], None), (3, "0", "header", runlog.HEADER_FIELDS[2], None), (4, "0", "gate", None, None), (5, "1", "entry", "grep", 2), (6, "1", "gate", None, None)]
    assert [r[2] for r in rows[6:]] == ["entry"] + ["audit"] * 6 and [r[0] for r in rows] == list(range(1, 14))


def test_many_writers_of_a_log(spark, tmp_path, monkeypatch):
    log, wrong = str(tmp_path / "log"), []
    monkeypatch.setattr(runlog, "MOST_FILES", 4)

    def write(who):
        try:
            for k in range(4):
                runlog.store(spark, log, cli._entry(spark, "r", "1", "entry", f"{who}{k}"))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = runlog.stored(spark, log).collect()
    assert not wrong and sorted(r.seq for r in rows) == list(range(1, 9)) and {r.tool for r in rows} == {f"{w}{k}" for w in "ab" for k in range(4)}
    assert [r.tool for r in sorted(rows, key=lambda r: r.seq) if r.tool[0] == "a"] == ["a0", "a1", "a2", "a3"]
