"""Reasoning texts and embeddings per claim from functions the caller provides.

The functions see batches inside Spark tasks. Results are kept in a table keyed by claim
id and a hash of the input text, so a rerun only asks for what is new or has changed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.draws import draw
from claimspark.functions.text import UNAVAILABLE, claim_description, claim_prompt, parse_reply, reasoning_text
from claimspark.plans.training import CATEGORICAL, TrainingResult, TreeConfig, train_single
from claimspark.session import shared_dir
from claimspark.sources.tables import path_exists

TRIES = 3
WAIT_SECONDS = 0.5
EMBED_BATCH = 64
REQUEST_ROWS = 16  # prompts of one call
IN_FLIGHT = 8  # calls that a task waits for at a time
SHARE_ROWS = 50_000  # claims that are asked for and committed together
SHARE_FILES = 16  # tasks that ask for a share

Predict = Callable[[list[str]], list[str]]
Encode = Callable[[list[str]], list[list[float]]]


def described(claims: DataFrame) -> DataFrame:
    """claim_id, description and its hash."""
    return claims.select("claim_id", claim_description(claims.columns).alias("description")).withColumn(
        "description_hash", F.md5("description")
    )


def answers(prompts: list[str], predict: Predict, tries: int = TRIES, wait: float = WAIT_SECONDS) -> list[str | None]:
    """Replies to the prompts of one call; a prompt that fails every time has none."""
    import time

    replies: list[str | None] = [None] * len(prompts)
    open_rows = list(range(len(prompts)))
    for attempt in range(tries):
        try:
            for i, reply in zip(open_rows, predict([prompts[i] for i in open_rows]), strict=True):
                replies[i] = reply
            break
        except Exception:
            if len(open_rows) > 1:
                # one bad prompt must not cost its call: go on one by one
                left = []
                for i in open_rows:
                    try:
                        replies[i] = predict([prompts[i]])[0]
                    except Exception:
                        left.append(i)
                open_rows = left
                if not open_rows:
                    break
        if attempt < tries - 1:
            time.sleep(wait * (attempt + 1))
    return replies


def ask(
    described_claims: DataFrame,
    predict: Predict,
    tries: int = TRIES,
    wait: float = WAIT_SECONDS,
    request_rows: int = REQUEST_ROWS,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """`reply` per claim. A task keeps at most `in_flight` calls of `request_rows` prompts running and hands replies on as they come."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for start in range(0, len(batch), request_rows * in_flight):
                    part = batch.iloc[start : start + request_rows * in_flight]
                    prompts = list(part["prompt"])
                    calls = [pool.submit(answers, prompts[i : i + request_rows], predict, tries, wait) for i in range(0, len(prompts), request_rows)]
                    yield part.drop(columns="prompt").assign(reply=[reply for c in calls for reply in c.result()])

    prompts = described_claims.select("claim_id", "description_hash", claim_prompt(F.col("description")).alias("prompt"))
    return prompts.mapInPandas(call, "claim_id string, description_hash string, reply string")


def to_reasoning(replies: DataFrame) -> DataFrame:
    """Replies as one reasoning text each; no reply gives the fallback text. A reply is parsed once for all its fields."""
    parsed = replies.withColumn("_parsed", parse_reply(F.col("reply")))
    text = F.when(F.col("reply").isNull(), F.lit(UNAVAILABLE)).otherwise(reasoning_text(F.col("_parsed")))
    return parsed.select("claim_id", "description_hash", text.alias("reasoning"))


def _same_claim(left: DataFrame, right: DataFrame, text_hash: str):
    """Claims match by identifier, null too, and by text; the text's hash spreads the rows without identifier."""
    return (left[text_hash] == right[text_hash]) & left["claim_id"].eqNullSafe(right["claim_id"])


def reasonings(
    claims: DataFrame,
    cache_path: str,
    predict: Predict,
    rounds: int | None = None,
    tries: int = TRIES,
    wait: float = WAIT_SECONDS,
    share_rows: int = SHARE_ROWS,
    request_rows: int = REQUEST_ROWS,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Reasoning per claim, also for claims without identifier.

    The open claims are asked for in shares of about `share_rows` (or in `rounds` shares), and each share is committed
    on its own: a run that fails loses one share at most, and the next run asks for the rest. The open claims are
    found once and written in a folder per share, so a share reads its own rows alone.
    """
    spark = claims.sparkSession
    texts = described(claims)
    if rounds is None:
        rounds = max(1, math.ceil(texts.count() / share_rows))
    work = texts.dropDuplicates(["claim_id", "description_hash"])
    if path_exists(spark, cache_path):
        done = spark.read.parquet(cache_path).select("claim_id", "description_hash").alias("done")
        work = work.join(done, _same_claim(work, done, "description_hash"), "left_anti")
    shared = work.withColumn("_share", F.pmod(draw(F.col("description_hash")), F.lit(rounds)).cast("int"))
    part = F.pmod(F.xxhash64("description_hash"), F.lit(SHARE_FILES))
    path = f"{shared_dir(spark)}/claimspark-{spark.sparkContext.applicationId}/shares-{uuid.uuid4().hex}"
    shared.repartition("_share", part).write.partitionBy("_share").parquet(path)
    open_work = spark.read.schema(shared.schema).parquet(path)
    for share in range(rounds):
        asked = ask(open_work.where(F.col("_share") == share), predict, tries, wait, request_rows, in_flight)
        to_reasoning(asked).write.mode("append").parquet(cache_path)
    cache = spark.read.parquet(cache_path).dropDuplicates(["claim_id", "description_hash"])
    return texts.join(cache, _same_claim(texts, cache, "description_hash")).select(texts["claim_id"], "reasoning")


def embed(texts: DataFrame, encode: Encode, text: str = "reasoning", batch_size: int = EMBED_BATCH) -> DataFrame:
    """`embedding` per claim from the caller's encoder, `batch_size` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors: list[list[float]] = []
            values = list(batch[text])
            for start in range(0, len(values), batch_size):
                vectors += [list(map(float, v)) for v in encode(values[start : start + batch_size])]
            yield batch.drop(columns=text).assign(embedding=vectors)

    return texts.select("claim_id", "text_hash", text).mapInPandas(
        run, "claim_id string, text_hash string, embedding array<float>"
    )


def embeddings(texts: DataFrame, cache_path: str, encode: Encode, text: str = "reasoning") -> DataFrame:
    """As `embed`, with a table of finished vectors; claims without identifier keep theirs."""
    spark = texts.sparkSession
    hashed = texts.withColumn("text_hash", F.md5(text))
    work = hashed.dropDuplicates(["claim_id", "text_hash"])
    if path_exists(spark, cache_path):
        done = spark.read.parquet(cache_path).select("claim_id", "text_hash")
        work = work.join(done, _same_claim(work, done, "text_hash"), "left_anti")
    embed(work, encode, text).write.mode("append").parquet(cache_path)
    cache = spark.read.parquet(cache_path).dropDuplicates(["claim_id", "text_hash"])
    return hashed.join(cache, _same_claim(hashed, cache, "text_hash")).select(hashed["claim_id"], "embedding")


def fit_embedder(texts: DataFrame, text: str = "reasoning", dims: int = EMBED_BATCH) -> PipelineModel:
    """Offline stand-in for an encoder: hashed words weighted by rarity in `texts`, without Python."""
    pipeline = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern="\\W+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
            IDF(inputCol="_tf", outputCol="_tfidf"),
        ]
    )
    return pipeline.fit(texts)


def hashed_embeddings(texts: DataFrame, embedder: PipelineModel) -> DataFrame:
    """Vectors of texts on the scale of the texts that the embedder was fitted on."""
    return embedder.transform(texts).select("claim_id", vector_to_array("_tfidf", "float32").alias("embedding"))


def with_embedding_columns(claims: DataFrame, vectors: DataFrame, dims: int, prefix: str = "reasoning_emb_") -> DataFrame:
    """Base features and one number column per vector position, matched by claim id."""
    spread = vectors.select(
        "claim_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(dims)]
    )
    return claims.join(spread, "claim_id", "left")


def with_embedding_vector(claims: DataFrame, vectors: DataFrame, dims: int, name: str = "reasoning_emb") -> DataFrame:
    """Base features and the embedding as one vector column; zeros where a claim has none."""
    none = F.array_repeat(F.lit(0.0), dims)
    joined = claims.join(vectors.select("claim_id", F.col("embedding").cast("array<double>").alias("_embedding")), "claim_id", "left")
    return joined.withColumn(name, array_to_vector(F.coalesce("_embedding", none))).drop("_embedding")


def train_with_reasoning(
    train: DataFrame,
    evaluation: DataFrame,
    train_vectors: DataFrame,
    eval_vectors: DataFrame,
    dims: int,
    config: TreeConfig = CATEGORICAL,
) -> TrainingResult:
    """The single-setting training on base features plus embeddings."""
    return train_single(
        with_embedding_vector(train, train_vectors, dims),
        with_embedding_vector(evaluation, eval_vectors, dims),
        config,
    )
