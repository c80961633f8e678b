"""Documents shorter than the item that they hold."""

from halogrid.llm import decontaminate


def test_item_with_a_word_left_out(spark):
    w = [f"w{i}" for i in range(60)]
    docs = [(1, w[:30] + w[31:]), (2, w[:48]), (3, w[:59]), (4, w[:4]), (5, w), (6, w[1:3])]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(w)), (8, "w1 w2 w3")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.leaks(df, items).collect()}
    long = {d: v for (d, i), v in got.items() if i == 7}
    assert long == {1: (0, 59, 51 / 60), 3: (0, 59, 55 / 56), 5: (0, 60, 1.0)}
    assert {d for d, i in got if i == 8} == {1, 2, 3, 4, 5}
