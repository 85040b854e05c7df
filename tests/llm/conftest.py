import pytest

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, one-word and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997} thing{i}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, base, "en"), (1, base, "en"), (2, base.upper() + " ", None), (3, None, "en"), (4, "", "fr"),
            (5, "   \n\t", "fr"), (6, "solo", None), (7, long, "en"), (8, long + " tail", "en"), (None, base, "en"),
            (None, None, None), (9, "1234 5678 !!", "de"), (10, "même texte élevé où", "fr"), (11, "solo", "en")]
    extra = ["row", "key", "sha", "kept", "label", "node", "body", "n", "rk1", "bits", "start", "spans", "score"]
    return spark.createDataFrame([(i, t, lang, None, None, *["x"] * len(extra)) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
