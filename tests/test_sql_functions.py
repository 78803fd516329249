"""Functions of SQL text against the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import similarity, sql
from refloom.functions.text import fold
from refloom.operators import report


def test_sql_functions_are_the_column_functions(spark):
    texts = ["Attention is all you need", "Attention Is All You Need.", "Produção e uso de tecnologia", "", None, "深度学习", "It's \\d {x}", "Mastering the game of Go with deep neural networks and tree search", "Silver (2016). Mastering the game of Go with deep neural networks and tree search. Nature"]
    rows = spark.createDataFrame([(i, a, b, [b, "Jonathan Ho 0001", None], 80.0 + i) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "i int, a string, b string, names array<string>, c double")
    sql.register(spark)
    rows.createOrReplaceTempView("pairs")
    by_text = spark.sql("select i, fold_text(a) f, word_overlap(a, b) w, text_similarity(a, b) s, title_similarity(a, b) t, author_similarity(a, names) n, paper_status(i % 3 > 0, c) p from pairs")
    a, b = F.col("a"), F.col("b")
    by_column = rows.select("i", fold(a).alias("f"), similarity.word_overlap(a, b).alias("w"), similarity.similarity(a, b).alias("s"), similarity.title_similarity(a, b).alias("t"), similarity.author_similarity(a, F.col("names")).alias("n"), report.ui_status(F.col("i") % 3 > 0, F.col("c")).alias("p"))
    assert by_text.exceptAll(by_column).count() == 0 and by_column.exceptAll(by_text).count() == 0
    assert "Python" not in by_text._jdf.queryExecution().optimizedPlan().toString()
