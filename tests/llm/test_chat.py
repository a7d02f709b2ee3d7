from netloom.llm.chat import preference_pairs, preference_turns, rendered, with_rejected


def brute(chosen, rejected):
    out = {}
    show = lambda t: f"<|{t[0]}|>\n{t[1]}\n<|end|>\n"
    for c in {r[0] for r in chosen + rejected if r[0] is not None}:
        sides = []
        for rows in (chosen, rejected):
            turns = {}
            for i, t, role, text in rows:
                if i == c and t is not None:
                    v = (role or "", text or "")
                    turns[t] = min(turns.get(t, v), v)
            sides.append(turns)
        if not sides[0] and not sides[1]:
            continue
        order = sorted(set(sides[0]) | set(sides[1]))
        n = 0
        while n < len(order) and sides[0].get(order[n]) == sides[1].get(order[n]):
            n += 1
        parts = ["".join(show(sides[0][t]) for t in order[:n])]
        masks = []
        for s in sides:
            text, mask = "", []
            for t in order[n:]:
                if t in s:
                    shown = show(s[t])
                    if s[t][0] == "assistant":
                        mask.append(f"{len(text)}:{len(text) + len(shown)}")
                    text += shown
            parts.append(text)
            masks.append(",".join(mask))
        out[c] = (*parts, *masks)
    return out


CHOSEN = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "é yes"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "q"), (4, 0, None, None), (5, 7, "user", "late"), (5, 7, "user", "a twin"),
    (None, 0, "user", "lost"), (6, None, "user", "lost"), (7, 0, "system", ""), (7, 1, "assistant", "x"),
]
REJECTED = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "no"), (1, 4, "user", "why"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "other"), (4, 0, "", ""), (5, 8, "user", "later"), (8, 0, "assistant", "only here"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_brute_force(spark):
    a, b = spark.createDataFrame(CHOSEN, SCHEMA), spark.createDataFrame(REJECTED, SCHEMA)
    got = {r.conv_id: (r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) for r in preference_pairs(a, b).collect()}
    assert got == brute(CHOSEN, REJECTED)
    assert got[2][1:] == ("", "", "", "") and got[1][0].count("<|end|>") == 3


def test_extra_columns_and_empty_tables(spark):
    a = spark.createDataFrame([(*r, 1, "p") for r in CHOSEN], SCHEMA + ", fork long, part string")
    assert preference_pairs(a, a).where("chosen <> '' or rejected <> ''").count() == 0
    assert preference_turns(a.limit(0), a.limit(0)).count() == 0
    assert preference_pairs(a, a.limit(0)).where("prompt <> ''").count() == 0


def test_rejected_side_lends_the_next_last_answer(spark):
    rows = {(r.conv_id, r.turn): r.text for r in with_rejected(spark.createDataFrame(CHOSEN, SCHEMA)).collect()}
    assert rows[1, 3] == "same" and rows[1, 1] == "hello" and rows[2, 1] == "same" and rows[7, 1] == "x"


def test_no_python_in_the_plan(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = preference_pairs(c, with_rejected(c))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert rendered is not None
