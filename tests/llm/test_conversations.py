import random

from memspark.llm.conversations import ROLES, conversation_report, conversations

ARGS = ("session_id", "turn_index", "speaker", "raw_text", ["at"])
SCHEMA = "session_id string, turn_index int, speaker string, raw_text string, at long, session string, msg string, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, "clash", "clash", 1) for i, r in enumerate(rows)], SCHEMA)


def brute(rows):
    by, bad = {}, set()
    for s, i, sp, t in rows:
        if s and s.strip():
            t = (t or "").strip(" \t\n ​")
            by.setdefault(s.strip(), {})
            if t:
                role = ROLES.get((sp or "").strip().lower()) if (sp or "").strip() else next((r for k, r in ROLES.items() if t.lower().startswith(k + ":")), None)
                by[s.strip()].setdefault((i, t), set()).add(role)
    for s, turns in by.items():
        roles = {k: next(iter(v - {None})) if len(v - {None}) == 1 else None for k, v in turns.items()}
        idx = [k[0] for k in turns]
        ok = bool(turns) and None not in idx and None not in roles.values() and len(set(idx)) == len(idx) and min(idx) in (0, 1) and max(idx) - min(idx) + 1 == len(idx)
        if ok:
            seq = [roles[k] for k in sorted(turns)]
            talk = [r for r in seq if r in ("user", "assistant")]
            ok = "user" in talk and "assistant" in talk and [r for r in seq if r != "system"][0] == "user" and talk[-1] == "assistant" and not any(a == b == "user" for a, b in zip(talk, talk[1:]))
        if not ok:
            bad.add(s)
    return bad, set(by)


def test_random_sessions_against_rules(spark):
    rnd = random.Random(2)
    rows = []
    for n in range(150):
        turns = [(f"s{n}", i + n % 2, ["user", " Assistant "][i % 2] if rnd.random() < 0.95 else rnd.choice([None, "tool", "sys", "who", "bot", ""]), f"text {i}") for i in range(rnd.randrange(1, 9))]
        for _ in range(rnd.randrange(2)):
            turns.insert(rnd.randrange(len(turns) + 1), rnd.choice(turns))  # delivered again
        if rnd.random() < 0.2:
            turns.pop(rnd.randrange(len(turns)))
        if rnd.random() < 0.2:
            t = rnd.choice(turns) if turns else ("s0", 0, "user", "x")
            turns.append((*t[:3], rnd.choice(["other", " ​ ", None, "", "user: hello"])))
        rows += turns
    rows += [("blank", 0, "user", "  ​ "), (None, 0, "user", "x"), ("  ", 0, "user", "x"), ("nul", None, "user", "x"), ("lead", 0, None, "USER: hi"), ("lead", 1, " ", "assistant > yes"), ("rep", 0, None, "a"), ("rep", 0, "user", "a"), ("rep", 1, "ai", "b")]
    bad, every = brute([r for r in rows if r[0] != "lead"])
    df = frame(spark, rows)
    got = {r.session for r in conversation_report(df, *ARGS).filter("reason is not null").collect()}
    assert got == bad | set() and "lead" not in got
    kept = conversations(df, *ARGS).collect()
    assert {r.session for r in kept} == (every | {"lead"}) - bad
    assert [(r.turn_no, r.role) for r in sorted(kept, key=lambda r: r.turn_no) if r.session == "rep"] == [(0, "user"), (1, "assistant")]


def test_overlapping_fragments_are_one_contig(spark):
    part = lambda a, b: [("s", i, ["user", "ai"][i % 2], f"m{i}") for i in range(a, b)]
    r = conversation_report(frame(spark, part(2, 6) + part(0, 4)), *ARGS).first()
    assert (r.reason, r.n_turns, r.n_rows, r.n_contigs) == (None, 6, 8, 1)
    r = conversation_report(frame(spark, part(0, 2) + part(4, 6)), *ARGS).first()
    assert (r.reason, r.n_contigs) == ("gap", 2)


def exports(spark, *parts):
    """Rows of fragments delivered one after the other: (session, first index or None, messages); user and assistant by turns of the letter."""
    rows, at = [], 0
    for session, first, said in parts:
        rows += [(session, None if first is None else first + i, ["user", "ai"]["abcdefghij".index(x) % 2], x) for i, x in enumerate(said)]
        rows.append((session, None, "user", None))  # blank rows are absent
    return frame(spark, rows)


def test_overlap_places_fragments_without_indexes(spark):
    """Only suffix-prefix matches of message hashes tell where fragments without indexes belong."""
    df = exports(spark, ("s", 4, "ef"), ("s", None, "cdef"), ("s", 9, "j"), ("s", None, "abcd"), ("s", 6, "ghij"))
    assert (r := conversation_report(df, *ARGS).first()).reason is None and (r.n_turns, r.n_rows, r.n_contigs) == (10, 15, 1)
    assert sorted((r.turn_no, r.text) for r in conversations(df, *ARGS).collect()) == list(enumerate("abcdefghij"))
    # no overlap: nothing tells the place of "ab"; two places for "ab": neither does
    assert conversation_report(exports(spark, ("s", 2, "cd"), ("s", None, "ab")), *ARGS).first().reason == "unplaced"
    assert conversation_report(exports(spark, ("s", 0, "abab"), ("s", None, "ab"), ("s", 4, "ef")), *ARGS).first().reason == "unplaced"
    # an overlap whose other end disagrees with what is there: two ways on
    assert conversation_report(exports(spark, ("s", 0, "abcdef"), ("s", None, "abcj"), ("s", 6, "gh")), *ARGS).first().reason == "conflict"


def test_sessions_without_any_index(spark):
    rows = [("n", None, ["user", "ai"]["abcdefgh".index(x) % 2], x) for x in "efgh"]
    assert conversation_report(frame(spark, rows), *ARGS).first().reason is None
    assert sorted((r.turn_no, r.text) for r in conversations(frame(spark, rows), *ARGS).collect()) == list(enumerate("efgh"))
    rows = [("n", None, ["user", "ai"]["abcdefgh".index(x) % 2], x, part) for part in ("efgh", "cdef", "abcd", "efgh") for x in part]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "session_id string, turn_index int, speaker string, raw_text string, part string, at long")
    assert sorted((r.turn_no, r.text) for r in conversations(df, *ARGS, export="part").collect()) == list(enumerate("abcdefgh"))


def test_delivered_three_times(spark):
    """A message that begins one fragment and stands inside two others has one way in."""
    df = exports(spark, ("s", 0, "abcd"), ("s", 2, "cd"), ("s", 0, "abcd"), ("s", 1, "bcd"))
    assert conversation_report(df, *ARGS).first().reason is None


def test_empty(spark):
    df = frame(spark, [("s", 0, "user", "x")]).limit(0)
    assert conversation_report(df, *ARGS).count() == 0 and conversations(df, *ARGS).count() == 0
