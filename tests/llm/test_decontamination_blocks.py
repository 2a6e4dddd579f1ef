"""An item whose rows fall in several blocks counts once, as it does in one block."""

from cutline.llm import decontaminate


def test_repeated_items_count_once_across_blocks(spark):
    items = [(1, "red green blue"), (2, "one two three"), (1, "red green blue"), (1, "four five six")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    docs = spark.createDataFrame([(0, "a red green blue b four five six c one two three"), (1, "nothing here"), (2, None)], "doc_id bigint, text string")
    one, more = ({r["doc_id"]: r.asDict() for r in decontaminate.contamination(docs, bench, block_bytes=n).collect()} for n in (1_000_000, 15))
    assert one == more and more[0]["n_items"] == 2
