"""Claim extraction and notice analysis around an injected model.

A model is any picklable callable from a prompt to an answer text; tests use a
deterministic stub.  Failures are values of a row, never of the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit import schemas
from quarrykit.functions import cost, jsonx, keys, text
from quarrykit.operators import claims, documents, ordered


def answered(rows: DataFrame, prompt: Column, model: Callable[[str], str]) -> DataFrame:
    """rows with answer and error of the model for each prompt."""
    schema = rows.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema
    ready = rows.withColumn("_prompt", prompt)

    def run(parts):
        for pdf in parts:
            answers, errors = [], []
            for p in pdf["_prompt"]:
                try:
                    answers.append(model(p))
                    errors.append(None)
                except Exception as error:
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            yield pdf.drop(columns="_prompt").assign(answer=pd.Series(answers, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object))

    return ready.mapInPandas(run, schema)


def extract_claims(docs: DataFrame, template: str, model: Callable[[str], str], vocabulary: list[str], key: str = "doc_id", per_section: int = 12) -> DataFrame:
    """Claims of all documents: sections, model, valid claims, best of a section, greedy merge, ids.

    key, name and start say where a claim was met first.  Claims are merged by
    document, section and their order there, which is that of confidence only
    where a section has more than per_section.
    """
    sections = documents.wanted_sections(documents.sections(docs, key)).select(key, "name", "start", "text")
    rows = answered(sections, text.fill_template(F.lit(template), {"section": F.col("name"), "text": F.col("text")}), model)
    parsed = rows.select(key, "name", "start", F.from_json(jsonx.json_in_text(F.col("answer")), schemas.ANSWER).alias("j"))
    each = parsed.select(key, "name", "start", F.posexplode("j.claims").alias("n", "c")).select(key, "name", "start", "n", "c.*")
    each = each.withColumnsRenamed({"proposal_sections": "sections", "length_variants": "variants"})
    each = claims.valid_claims(each).withColumn("tags", claims.vocabulary_tags(F.col("tags"), vocabulary))
    section = [key, "name", "start"]
    sized = each.withColumn("_all", F.count("*").over(Window.partitionBy(*section)))
    best = ordered.top_k(sized, section, [F.desc("confidence"), "n"], per_section)
    best = best.withColumn("place", F.when(F.col("_all") > per_section, F.col("rank")).otherwise(F.col("n"))).drop("_all", "rank")
    best = best.withColumn("id", F.xxhash64(key, "name", "n"))
    return claims.greedy_merge(best, order=[key, "start", "place"]).withColumn("claim_id", keys.claim_id(F.col(key).cast("string"), F.col("statement"))).drop("place")


def input_route(text: Column, kind: Column, size: Column, most: int = 30_000_000) -> Column:
    """How a notice is analysed: simple without text, binary for PDF files below most bytes, else text."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    binary = F.coalesce((F.lower(kind) == "pdf") & (size < most), F.lit(False))
    return F.when(blank, "simple").when(binary, "binary").otherwise("text")


def analyse(notices: DataFrame, balances: DataFrame, files: DataFrame, template: str, model: Callable[[str], str], account: str = "account") -> DataFrame:
    """Answers for the notices whose account can pay: full where a parsed file has text, simple elsewhere."""
    from quarrykit.operators import ledger

    paying = ledger.may_spend(balances).select(account)
    texts = files.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("notice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "\n").alias("file_text"))
    rows = notices.join(paying, account, "left_semi").join(texts.withColumnRenamed("notice_id", "id"), "id", "left")
    rows = rows.withColumn("mode", F.when(F.col("file_text").isNotNull(), "full").otherwise("simple"))
    body = F.coalesce(text.clip(F.col("file_text"), 2000), F.col("content"))
    out = answered(rows, text.fill_template(F.lit(template), {"title": F.col("title"), "text": body}), model)
    return out.withColumn("state", F.when(F.col("error").isNull(), "completed").otherwise("failed"))


def usage(calls: DataFrame, key: str = "source_id") -> DataFrame:
    """Tokens, calls and cost of each source."""
    p_in, p_out = cost.prices_of(F.col("model"))
    priced = calls.withColumn("cost", cost.token_cost(p_in, p_out, F.col("tokens_in"), F.col("tokens_out")))
    return priced.groupBy(key).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 1).alias("cost"))
