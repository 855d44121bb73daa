from pyspark.sql import functions as F

from wayline.llm.chat import conversations_as_turns, format_preferences, reply_pairs, trained_ranges

TURN = "array<struct<role:string,text:string>>"


def test_prefix_prompt_and_masks(spark):
    chosen = [("system", "s"), ("user", "q"), ("assistant", "good")]
    rejected = [("system", "s"), ("user", "q"), ("assistant", "bad"), ("user", "")]
    rows = [(0, chosen, rejected), (1, chosen[1:2], chosen[1:2]), (2, chosen, None), (3, chosen[:1], chosen[1:]), (4, [("user", "z" * 50_000)], [])]
    out = {r["k"]: r for r in format_preferences(spark.createDataFrame(rows, f"k int, chosen {TURN}, rejected {TURN}")).collect()}
    a = out[0]
    assert a["n_prompt_turns"] == 2
    assert a["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert [tuple(s) for s in a["chosen_spans"]] == [("<|im_start|>assistant\n", False), ("good<|im_end|>\n", True)]
    assert [tuple(s) for s in a["rejected_spans"]][2:] == [("<|im_start|>user\n", False), ("<|im_end|>\n", False)]
    assert out[1]["n_prompt_turns"] == 1 and out[1]["chosen_spans"] == [] == out[1]["rejected_spans"]
    assert out[2]["prompt"] == "" and out[2]["rejected_spans"] == [] and len(out[2]["chosen_spans"]) == 6
    assert out[3]["n_prompt_turns"] == 0 and len(out[4]["chosen_spans"][1]["text"]) > 50_000


def test_pairs_exchange_the_last_answer(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "äé𝄞 b"), (0, 4, "user", "bye"),
        (1, 0, "user", "r"), (1, 1, "assistant", "c"), (2, 0, "user", "alone"), (2, 1, "assistant", "d"), (3, 0, "user", "none"),
        (None, 0, "user", "lost"), (6, 5, "assistant", "b"), (6, None, None, "a"), (6, 5, "assistant", "b"), (7, 0, "assistant", "b"), (7, 0, "assistant", None),
        (-2, 0, "assistant", "x"), (-1, 0, "assistant", "y"), (2**53 + 2, 0, "assistant", "big"), (2**53 + 3, 0, "assistant", "bigger"),
    ]
    pairs = reply_pairs(conversations_as_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    out = {r["conv_id"]: r for r in format_preferences(pairs).withColumns({"c": trained_ranges(F.col("chosen_spans")), "r": trained_ranges(F.col("rejected_spans"))}).collect()}
    assert sorted(out) == [-2, -1, 0, 1, 2, 3, 6, 7, 2**53 + 2, 2**53 + 3]
    said = lambda k, side: [(t["role"], t["text"]) for t in out[k][side]]
    assert out[0]["n_prompt_turns"] == 3 and out[0]["partner_id"] == 1
    assert said(0, "rejected") == [("user", "q"), ("assistant", "a"), ("user", "more"), ("assistant", "c")]
    for k, side in ((0, "chosen"), (0, "rejected"), (6, "chosen"), (2, "chosen")):
        spans = out[k][f"{side}_spans"]
        text = "".join(s["text"] for s in spans)
        assert [text[r["start"] : r["end"]] for r in out[k][side[0]]] == [s["text"] for s in spans if s["train"]]
    assert [tuple(r) for r in out[0]["c"]] == [(22, 38)]
    assert out[2]["partner_id"] is None and out[2]["n_prompt_turns"] == 1 and out[2]["rejected_spans"] == []
    assert out[3]["partner_id"] is None and out[3]["n_prompt_turns"] == 1 and out[3]["chosen_spans"] == [] == out[3]["rejected_spans"]
    assert said(6, "chosen") == [("user", "a"), ("assistant", "b"), ("assistant", "b")] == said(6, "rejected") and out[6]["n_prompt_turns"] == 3
    assert said(7, "rejected") == [("assistant", ""), ("assistant", "b")] and out[-2]["partner_id"] == -1 and said(2**53 + 3, "rejected") == [("assistant", "big")]


def test_empty_and_clashing_names(spark):
    schema = f"pair_id long, prompt int, chosen {TURN}, rejected {TURN}"
    out = format_preferences(spark.createDataFrame([(1, 7, None, [("user", "a")])], schema))
    assert out.columns == ["pair_id", "prompt", "chosen", "rejected", "n_prompt_turns", "chosen_spans", "rejected_spans"]
    assert out.first()["prompt"] == ""
    assert format_preferences(spark.createDataFrame([], schema)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert reply_pairs(conversations_as_turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
