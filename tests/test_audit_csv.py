import random

from pyspark.sql import functions as F

from altloom.sources import tables

TEXTS = [
    None, "", " ", " lead", "trail ", "\ta\t", "\n", "\r", "\r\n", "a\r\nb", "a\rb", "a\n", '"', '""', '"a"', ' "x" ', ",", "a,b", "\\", '\\"', '\x00"',
    "\x00a", "\x01", "#a", "\u00a0a\u00a0", "\u3000", "\ufeffa", "a\u2028b", "ß", "\U0001f600", "\\N", "null", 'a,"\r\n",b', "x" * 40000,
]


def test_audit_csv_gives_back_every_text(spark, tmp_path):
    draw = random.Random(7)
    texts = TEXTS + ["".join(draw.choices('",\n\r a\\\t#\x00', k=draw.randint(1, 7))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(3)
    own = {"image_id": F.col("n").cast("string"), "alt_text": F.col("t"), "notes": F.array(F.lit("small"), F.lit("x"))}
    tables.write_audit_csv(rows.select(*[own.get(c, F.lit("a")).alias(c) for c in tables.AUDIT]), f"{tmp_path}/audit")
    back = tables.read_audit_csv(spark, f"{tmp_path}/audit").select("image_id", "alt_text", "notes").collect()
    assert sorted((int(r[0]), r[1]) for r in back if r[1] is not None) == [(n, t) for n, t in enumerate(texts) if t is not None]
    assert [r[0] for r in back if r[1] is None] == ["0"]
    assert {r[2] for r in back} == {"small; x"}
