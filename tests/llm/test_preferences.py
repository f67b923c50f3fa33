import duckdb

from iontide.llm import preference_format as m


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")


CHOSEN = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (3, 0, "user", "same"), (3, 1, "assistant", "end"), (4, None, None, None), (None, 0, "user", "lost"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]
REJECTED = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "b"), (3, 0, "user", "same"), (3, 1, "assistant", "end"), (4, None, None, None), (5, 0, "user", "alone"), (6, 0, "user", "hi")]


def test_prefix_once_and_completions(spark):
    rows = m.format_pairs(turns(spark, CHOSEN), turns(spark, REJECTED)).collect()
    found = {(r.pair_id, r.part, r.turn): (r.role, r.text, r.copies) for r in rows}
    assert len(found) == len(rows)
    assert found[1, "prompt", 0] == ("user", "hi", 1)
    assert found[1, "chosen", 1] == ("assistant", "yes", 1) and found[1, "rejected", 2] == ("user", "why", 1)
    assert (2, "prompt", 0) not in found and {p for i, p, _ in found if i == 3} == {"prompt"}
    assert found[4, "prompt", m.FIRST_TURN] == (None, None, 1) and (5, "rejected", 0) in found
    assert found[6, "chosen", 0][2] == 2 and found[6, "rejected", 0][2] == 1


def test_assembled_pairs(spark):
    rows = {r.pair_id: r for r in m.assemble(m.format_pairs(turns(spark, CHOSEN), turns(spark, REJECTED))).collect()}
    assert rows[1].prompt == "<|user|>\nhi<|end|>\n" and rows[1].chosen == "<|assistant|>\nyes<|end|>\n" and rows[1].piece == 0
    assert rows[1].chosen_mask == "14:11" and rows[1].rejected_mask == "14:10 20:0"
    assert sum(int(n) for run in rows[1].rejected_mask.split() for n in run.split(":")) == len(rows[1].rejected)
    assert rows[4].prompt == "<||>\n<|end|>\n" and (rows[4].chosen, rows[4].chosen_mask) == ("", "")
    assert rows[6].chosen == 2 * rows[6].rejected and len(rows) == 6


def test_long_conversations_are_in_pieces(spark):
    rows = m.assemble(m.format_pairs(turns(spark, [(1, i, "user", "x" * 5000) for i in range(200)]), turns(spark, [(1, i, "user", "x" * 5000) for i in range(130)]))).collect()
    assert sorted((r.piece, len(r.prompt), len(r.chosen)) for r in rows) == [(0, 64 * 5017, 0), (1, 64 * 5017, 0), (2, 2 * 5017, 62 * 5017), (3, 0, 8 * 5017)]


ROWS = [(0, 0, "user", "q"), (0, 1, "assistant", "x"), (0, 2, "user", "more"), (1, 0, "system", "s"), (1, 1, "assistant", "yé"), (2, 0, "user", "no reply"), (3, 0, "assistant", "z"), (4, 0, "user", "q"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, "user", "v"), (5, 300, "assistant", "same"), (8, 0, "user", "q"), (8, 1, "assistant", "x"), (9, None, None, None), (10, 0, "user", None)]


def queried(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id string").write.parquet(f"{folder}/conversations.parquet")
    return m.op6_preference_format(spark, str(folder))


def test_query_against_sql(spark, tmp_path):
    found = queried(spark, tmp_path, [(*r, "clash") for r in ROWS])
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    true = db.sql(m.OP6_SQL)
    assert sorted(tuple(r) for r in found.select(true.columns).na.fill(-1).collect()) == sorted(tuple(-1 if v is None else v for v in r) for r in true.fetchall())
    # Every message is rendered once in its pair, common ones once for both.
    rendered = sum((r.prompt + r.chosen + r.rejected).count("<|end|>") for r in found.collect())
    common = sum(r.prompt.count("<|end|>") for r in found.collect())
    assert rendered + common == len(ROWS)


def test_query_on_an_empty_table(spark, tmp_path):
    assert queried(spark, tmp_path, [(None, 0, "user", "lost", "clash")]).count() == 0


def test_no_python_in_the_plan(spark, tmp_path):
    plans = [m.format_pairs(turns(spark, CHOSEN), turns(spark, REJECTED)), queried(spark, tmp_path, [(*r, "clash") for r in ROWS])]
    for frame in plans:
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert m.assemble(m.format_pairs(turns(spark, []), turns(spark, []))).count() == 0
