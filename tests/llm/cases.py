"""Odd documents that every operator must take."""

from __future__ import annotations

EXTRA = "shard string, score string, spans string, kept string, lang_pred string, class_id string, families string, ids string, decoded string, n_tokens string, host string, __q string, t string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA

PROSE = "The committee met in the old hall and talked about the bridge that was to be built over the river in the spring of the year"
LONG = " ".join(f"word{i % 977} of the {i % 31}" for i in range(20_000))


def odd_rows() -> list[tuple]:
    texts = [
        None,
        "",
        " \n\t \n",
        "\n",
        "one",
        "four words and done",
        PROSE,
        PROSE,
        PROSE.upper(),
        PROSE + "\n" + PROSE + "\n" + PROSE,
        LONG,
        "#### $$$$ %%%% &&&& **** ||||",
        "日本語のテキスト。これは短い文です。 😀 é e\u0301",
        "x" * 5000,
        "a\x1cb\x85c\u2028d\r\ne",
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 else "src", len(t) if t is not None else None, *["clash"] * 13) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, PROSE, None, None, None, *[None] * 13), (None, None, None, None, None, *[None] * 13)]


def odd_docs(spark, repartition: int = 3):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(repartition)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table_folder(tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
