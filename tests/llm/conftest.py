from __future__ import annotations

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, length bigint, copy string, "
    "kept string, fp string, sequence_id string, component_id string, spans string, base string, norm string, words string"
)


def tricky_texts() -> list[str | None]:
    clean = "The plan of the town was to be read by all that live in it, and it was good for them. "
    return [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "one two",
        "A b C a B c a b c",
        clean * 4,
        clean * 4,
        clean * 3 + "Call +1 (386) 555-3733 or mail a.b@c.example.com now.",
        "x@y.zz_k@w.vv a@b@c.de 1.2.3.4.5.6.7.8 256.1.1.1 00001.002.3.255 a@b..c @x.y",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890 +1+2 +49 (30) 1234.5678- +1......",
        "CC BY cc-by cc by by CC_BY\x7fall rights reserved GENERAL public License general public licensecc by",
        "Kelvin K İ É é ß ﬁ 😀 x😀y naïve   z\x85w 😀 a@b.cc 1.1.1.1",
        "line\nline\n line\nline \n\nline\r\nline\r",
        "###$$$%%% <|> & * THE END!! " * 30,
        "go go go go go go go go " * 20,
        "word%d " % 7 * 40 + "0123456789 " * 30,
        "".join(f"w{i} " for i in range(30_000)) + "w1 w2 w3",
        "7" * 50_000 + " " + "1.2.3." * 5_000 + " " + "a." * 20_000 + "@" + "b." * 20_000 + "c",
        "Licensed under the Apache License, Version 2.0. " * 3 + clean,
    ]


def tricky_rows() -> list[tuple]:
    rows = []
    for i, text in enumerate(tricky_texts()):
        source = [None, "a", "b", "c"][min(i % 5, 3)]
        rows.append((i, text, ["en", None, "xx", "de"][i % 4], source, len(text or ""), 1, "c", "k", "f", "s", "m", "p", "b", "n", "w"))
    rows.append(rows[8])  # a repeated row
    rows.append(rows[1])
    rows.append((None, "no id at all in this row", *rows[3][2:]))
    rows.append((None, None, *rows[3][2:]))
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls, empty and very long texts, repeated rows and clashing column names."""
    return spark.createDataFrame(tricky_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
