"""Every compatibility form, alone and among other characters, as its plain characters."""

from pyspark.sql import functions as F

from studyloom.functions import text as T


def test_every_form(spark):
    src, dst = T.fold_tables()
    plain = dict(zip(src, dst)) | T.fold_many()
    rows = [(c, n) for c, n in plain.items()] + [(f"a{c}b é{c}{c}\n{c}", f"a{n}b é{n}{n}\n{n}") for c, n in T.fold_many().items()]
    rows += [("plain ascii", "plain ascii"), ("é\x80 \x7f", "é\x80 \x7f"), ("", ""), ("".join(T.fold_many()), "".join(T.fold_many().values()))]
    d = spark.createDataFrame(rows, "c string, n string").select("c", "n", T.fold(F.col("c")).alias("got"))
    assert d.filter("got <> n").collect() == []
