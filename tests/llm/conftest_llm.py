"""Small tables for the tests of this folder."""

import random

SF = "/root/testdata/sf0.01"


def make_sf(spark, tmp_path, toxic_word="grrr", n=600) -> str:
    r = random.Random(9)
    base = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(base) for _ in range(r.randrange(20, 120))]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            text.insert(r.randrange(len(text)), toxic_word)
        docs.append((i, " ".join(text), "en", "a", len(text)))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)
