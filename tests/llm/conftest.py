import random

import pytest

GOOD = {"en": "the of and to in that it was for with he on are as they be at one have this from or had by hot but some what there we can out other were all your when up use word how said each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find",
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wenn unter wir soll schon keine dann jetzt sehr hier alle immer Straße Mädchen schön größer können müssen"}


def words(lang, n, rng):
    return " ".join(rng.choice(GOOD[lang].split()) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source: prose in two languages, copies, near copies, repeated lines, insults, odd texts."""
    rng = random.Random(4)
    out = []
    shared = "this very same line stands in many of the documents here"
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        text = "\n".join(words(lang, rng.randint(6, 30), rng) for _ in range(rng.randint(1, 6)))
        if i % 4 == 1:
            text += "\n  " + shared.upper() + " \t\n" + words(lang, 8, rng)
        if i % 5 == 2:
            text = text.replace(" ", " idiot ", 1) + " you stupid moron"
        if i % 6 == 3:
            text = " | ".join(text.split())
        out.append((i, text, lang, f"src{i % 4}" if i % 9 else "src0"))
    long = words("en", 6000, rng)
    out += [(200, out[4][1], "en", "src1"), (201, long, "en", "src2"), (202, long + " end", "en", "src2"), (203, long.replace("the", "The", 1), None, None)]
    out += [(204, None, None, "src3"), (205, "", "en", None), (206, "  \n\n ", None, "src3"), (207, "12 34 ²", "en", "src3"), (None, "no id here at all", "en", "src3"), (208, "a b", "en", "src3")]
    out += [(209, "İstanbul ΣΑΣ don't <|endoftext|> 漢字 é x\x1cy 🙂", None, "src3"), (210, out[5][1], "en", "src1"), (210, out[5][1], "en", "src1")]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs_dir(spark, rows, tmp_path_factory):
    """The tables as Parquet, with extra columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    at = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("row", "utf8", "score", "keys", "kept", "fp", "key", "label", "target", "slot", "taken", "held_out", "size", "file", "line", "task", "rid", "none", "id"):
        df = df.withColumn(name, F.lit("clash"))
    df.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int("|" not in (r[1] or "")), int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 150] + [(3, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA + ", n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at
