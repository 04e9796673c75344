"""Values of op7 are read from the examples written out in full."""

from pyspark.sql import functions as F

from rankloom.llm import chat


def test_values_come_from_the_text_of_examples_in_full(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a ## b"), (1, 1, "assistant", "one"), (1, 2, "user", "more"), (1, 3, "assistant", "two </turn>"), (1, 4, "user", "end"), (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    written = chat.write_examples(chat.format_turns(turns))
    full = chat.render(written).collect()
    assert all(x["text"].startswith("### user: a \\#") or x["text"].startswith("### user: a #") for x in full)
    # Lengths and offsets that were counted on the way are not trusted.
    back = {r["conv_id"]: r for r in chat.read_back(written.withColumn("example_chars", F.lit(0)).withColumn("context_chars", F.lit(0))).collect()}
    assert back[1]["formatted_chars"] == sum(len(x["text"]) for x in full)
    assert back[1]["loss_text"] == "onetwo </turn>"
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "a ## b"), ("assistant", "one"), ("user", "more"), ("assistant", "two </turn>"), ("user", "end")]
    assert (back[2]["n_turns"], back[2]["formatted_chars"], back[2]["loss_text"]) == (1, 0, "")
