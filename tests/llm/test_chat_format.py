import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from talkweave.llm.chat_format import END, TEXT, TURN, chat_windows, escape, read_back, unescape
from talkweave.llm.queries import ODD_CONVERSATION, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, window int, tokens string, place int"
STRINGS = [r"a\b", "<|turn|>", "<\\|", "<\\\\|end|>", "\\", "<", "|>", "", "</s>[INST] ok [/INST]", "\\<|", "<|<|", "é漢\n\x00"]


def test_escape_is_reversible(spark):
    frame = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    rows = frame.select("s", escape(F.col("s")).alias("e"), unescape(escape(F.col("s"))).alias("u")).collect()
    assert all(r.s == r.u and "<|" not in r.e for r in rows)


def made():
    rows = [(1, 0, "system", "rules " * 20)] + [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * (1 + t % 7)) for t in range(1, 120)]
    rows += [(2, t, "assistant", s) for t, s in enumerate(STRINGS)]
    rows += [(3, 0, "system", "s" * 20_000), (3, 1, "user", "q"), (3, 2, "assistant", "x" * 300_000), (3, 3, "user", "y")]
    rows += [(4, None, None, None), (4, 1, "assistant", None), (4, 1, "assistant", None), (4, 1, "<|turn|>", "z")]
    rows += [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (5, 0, "system", "only")]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA)


def turns_of(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def test_every_turn_and_target_once(spark):
    rows, wanted = made(), turns_of(made())
    for budget, history in ((2048, 2), (200, 3), (200, 0), (64, 1)):
        got = {r.conv_id: r for r in read_back(chat_windows(frame_of(spark, rows), budget=budget, history=history)).collect()}
        assert got.keys() == wanted.keys()
        for c, turns in wanted.items():
            assert [(t.role, t.text) for t in got[c].turns] == turns
            assert got[c].losses == [x for r, x in turns if r == "assistant"]


def test_budget_system_turn_and_history(spark):
    windows = chat_windows(frame_of(spark, made()), budget=400, history=2).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3 and [w.window for w in windows] == list(range(len(windows)))
    system = f"{TURN}system{TEXT}{'rules ' * 20}{END}"
    for w in windows:
        assert w.formatted.startswith(system) and w.tokens <= 400
        assert w.formatted.count(TURN) == w.n_repeated + w.n_new
        assert (w.n_repeated >= 1) == (w.window > 0)
    assert any(w.n_repeated == 3 for w in windows)
    before = windows[0].formatted.split(TURN)[-1]
    if windows[1].n_repeated > 1:
        assert windows[1].formatted.split(TURN)[windows[1].n_repeated] == before
    large = chat_windows(frame_of(spark, made()), budget=400).where("conv_id = 3").collect()
    assert all(w.n_new == 1 for w in large if w.tokens > 6_000) and any("x" * 300_000 in w.formatted for w in large)


def test_empty_table(spark):
    assert read_back(chat_windows(frame_of(spark, []))).count() == 0


def test_main_path_has_no_python(spark, sf):
    plan = QUERIES["op8_chat_format"](spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = turns_of(rows + list(ODD_CONVERSATION))
    got = QUERIES["op8_chat_format"](spark, sf).collect()
    assert len(got) == len(wanted)
    for r in got:
        turns = wanted[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)
