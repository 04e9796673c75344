"""MovieLens 100K and 1M from their unpacked folders. Nothing is downloaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import leave_one_out, tail_rows

#: Order of a user's rows; a pair occurs once, so it is total.
ORDER = ("timestamp", "item_id")
#: Official splits of 100K.
SPLITS_100K = ("u1", "u2", "u3", "u4", "u5", "ua", "ub")
_RATINGS = "user_id LONG, item_id LONG, rating DOUBLE, timestamp LONG"


def _no_repeats(ratings: DataFrame) -> DataFrame:
    again = ratings.groupBy("user_id", "item_id").count().filter("count > 1").head(1)
    if again:
        raise ValueError(f"user {again[0][0]} rated item {again[0][1]} {again[0][2]} times")
    return ratings


def ratings_100k(spark: SparkSession, path: str) -> DataFrame:
    return _no_repeats(spark.read.csv(f"{path}/u.data", sep="\t", schema=_RATINGS, mode="FAILFAST"))


def split_100k(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of an official split, each a semi-join of the ratings; a split's pair
    that is no rating is an error."""
    if name not in SPLITS_100K:
        raise ValueError(f"no split {name!r}; there are {SPLITS_100K}")
    ratings, out = ratings_100k(spark, path), []
    for part in ("base", "test"):
        pairs = spark.read.csv(f"{path}/{name}.{part}", sep="\t", schema=_RATINGS, mode="FAILFAST").select("user_id", "item_id")
        lost = pairs.join(ratings, ["user_id", "item_id"], "left_anti").head(1)
        if lost:
            raise ValueError(f"{name}.{part} has a pair that was not rated: {lost[0].asDict()}")
        out.append(ratings.join(pairs, ["user_id", "item_id"], "left_semi"))
    return out[0], out[1]


def users_100k(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(f"{path}/u.user", sep="|", schema="user_id LONG, age LONG, gender STRING, occupation STRING, zip_code STRING", mode="FAILFAST")


def items_100k(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, title, release_date, imdb_url, genres array<boolean>), Latin-1 text."""
    genres = spark.read.csv(f"{path}/u.genre", sep="|", schema="name STRING, n INT").filter("name IS NOT NULL").count()
    flags = [f"g{i} INT" for i in range(genres)]
    rows = spark.read.csv(f"{path}/u.item", sep="|", encoding="ISO-8859-1", quote="", schema=", ".join(["item_id LONG", "title STRING", "released STRING", "video STRING", "imdb_url STRING", *flags]))
    date = F.try_to_timestamp("released", F.lit("dd-MMM-yyyy")).cast("date")
    return rows.select("item_id", "title", date.alias("release_date"), "imdb_url", F.array(*[F.col(f"g{i}").cast("boolean") for i in range(genres)]).alias("genres"))


def _dat(spark: SparkSession, path: str, names: list[str], casts: dict[str, str]) -> DataFrame:
    parts = F.split("value", "::")
    rows = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="", schema="value STRING")
    return rows.select(*[parts[i].cast(casts.get(n, "string")).alias(n) for i, n in enumerate(names)])


def ratings_1m(spark: SparkSession, path: str) -> DataFrame:
    return _no_repeats(_dat(spark, f"{path}/ratings.dat", ["user_id", "item_id", "rating", "timestamp"], {"user_id": "long", "item_id": "long", "rating": "double", "timestamp": "long"}))


def users_1m(spark: SparkSession, path: str) -> DataFrame:
    return _dat(spark, f"{path}/users.dat", ["user_id", "gender", "age", "occupation", "zip_code"], {"user_id": "long", "age": "long", "occupation": "long"})


def year_of(title):
    """The year in parentheses at a title's end; null if there is none."""
    found = F.regexp_extract(title, r"\((\d{4})\)\s*$", 1)
    return F.when(found != "", found.cast("int"))


def items_1m(spark: SparkSession, path: str) -> DataFrame:
    rows = _dat(spark, f"{path}/movies.dat", ["item_id", "title", "genres"], {"item_id": "long"})
    return rows.select("item_id", "title", year_of(F.col("title")).alias("year"), F.split("genres", r"\|").alias("genres"))


def leave_one_out_1m(spark: SparkSession, path: str, max_sequence_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): each user's last rating is the test; histories may be cut to the last
    ``max_sequence_length`` before it."""
    ratings = ratings_1m(spark, path)
    if max_sequence_length is not None:
        ratings = tail_rows(ratings, ORDER, max_sequence_length, held_out=True)
    marked = leave_one_out(ratings, ORDER)
    return marked.filter("NOT test").drop("test"), marked.filter("test").drop("test")
