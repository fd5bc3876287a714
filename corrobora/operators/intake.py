"""From evidence to extracted claims: prompts, stored replies, the external call, tolerant reading of replies.

A reply is one row; its items stay in arrays of that row until they are exploded, so nothing is shuffled here.
"""

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.memo import built_once
from ..functions.text import let, settled, strip


def _attribute(c: Column) -> Column:
    value = c.cast("string")
    return F.translate(F.when(value.isNull() | (value == ""), "n/a").otherwise(value), "\"\n", "' ")


def evidence_block(eid: Column, document: Column, page: Column, section: Column, text: Column) -> Column:
    """One passage as the model sees it; it cannot close its own block."""
    safe = F.replace(text, F.lit("</evidence"), F.lit("<\\/evidence"))
    return F.concat(F.lit('<evidence id="'), eid, F.lit('" document="'), _attribute(document), F.lit('" page="'), _attribute(page),
                    F.lit('" section="'), _attribute(section), F.lit('">\n'), safe, F.lit("\n</evidence>"))


def prompts(questions: DataFrame, evidence: DataFrame, system: str) -> DataFrame:
    """question_id, system, user, recording_key. A question has at most ten evidence blocks."""
    block = evidence_block(*[F.col(c) for c in ("eid", "document", "page", "section", "text")])
    blocks = evidence.groupBy("question_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda r: r["b"]), "\n").alias("blocks"))
    user = F.concat(F.lit("QUESTION:\n"), F.col("question"), F.lit("\n\nEVIDENCE:\n"), F.col("blocks"))
    built = questions.join(blocks, "question_id").select("question_id", F.lit(system).alias("system"), user.alias("user"))
    return built.withColumn("recording_key", recording_key(F.col("system"), F.col("user")))


def recording_key(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(system, F.lit("\n---\n"), user), 256)


def split_recorded(asked: DataFrame, recordings: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(prompts with a stored reply, prompts to send). `live` sends all, `replay` sends the misses, `mock` sends none."""
    hits = asked.join(recordings.select("recording_key", "model", "raw_response"), "recording_key")
    misses = asked.join(recordings.select("recording_key"), "recording_key", "left_anti")
    return hits, {"live": asked, "replay": misses, "mock": asked.filter(F.lit(False))}[mode]


def resolve(asked: DataFrame, recordings: DataFrame, called: DataFrame, mode: str) -> DataFrame:
    """One reply per prompt: `live` prefers the call and falls back on the recording, other modes the reverse."""
    stored = recordings.select("recording_key", F.col("model").alias("stored_model"), F.col("raw_response").alias("stored"))
    fresh = called.filter("status = 'ok'").select("recording_key", F.col("model").alias("fresh_model"), F.col("raw_response").alias("fresh"))
    rows = asked.join(stored, "recording_key", "left").join(fresh, "recording_key", "left")
    order = ("fresh", "stored") if mode == "live" else ("stored", "fresh")
    source = F.when(F.col(order[0]).isNotNull(), order[0]).when(F.col(order[1]).isNotNull(), order[1]).otherwise("none")
    names = {"fresh": "live", "stored": "recording", "none": "none"}
    label = F.when(source == "fresh", names["fresh"]).when(source == "stored", names["stored"]).otherwise("none")
    return rows.select("question_id", "recording_key", F.coalesce(*order).alias("raw_response"),
                       F.coalesce(*[F.col(f"{o}_model") for o in order]).alias("model"), label.alias("llm_source"))


class CallFailed(Exception):
    """A failed request; `retryable` allows one more try of the primary model."""

    def __init__(self, detail: str, retryable: bool):
        super().__init__(detail)
        self.retryable = retryable


_CALL = T.StructType([T.StructField(n, t) for n, t in (
    ("recording_key", T.StringType()), ("status", T.StringType()), ("model", T.StringType()), ("raw_response", T.StringType()),
    ("attempts", T.IntegerType()), ("error", T.StringType()))])


def call_models(asked: DataFrame, make_client: Callable[[], Callable[[str, list], str]], models: list[str], callers: int) -> DataFrame:
    """Send every prompt: primary twice if retryable, each fallback once, one repair of an unreadable reply.

    `callers` partitions bound the requests in flight. Failures are rows, never task failures.
    """
    def answer(client, system: str, user: str) -> tuple:
        history = [("system", system), ("user", user)]
        attempts, retry, error = 0, True, "nothing was sent"
        for model in [models[0], *models]:
            if attempts == 1 and not retry:
                retry = True
                continue
            attempts += 1
            try:
                raw = client(model, history)
            except Exception as failed:  # whatever goes wrong is this prompt's row
                retry, error = getattr(failed, "retryable", False), f"{model}: {failed}"
                continue
            if well_formed(raw):
                return "ok", model, raw, attempts, None
            attempts += 1
            try:
                raw = client(model, [*history, ("assistant", raw), ("user", "That could not be read as the object described above. Send that object again, complete, and nothing else.")])
            except Exception as failed:
                return "bad_output", model, None, attempts, str(failed)
            readable = well_formed(raw)
            return ("ok" if readable else "bad_output"), model, raw if readable else None, attempts, None if readable else "unreadable reply"
        return "unavailable", None, None, attempts, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            rows = [(k, *answer(client, s, u)) for k, s, u in zip(pdf["recording_key"], pdf["system"], pdf["user"])]
            yield pd.DataFrame(rows, columns=[f.name for f in _CALL.fields])

    distinct = asked.groupBy("recording_key").agg(F.first("system").alias("system"), F.first("user").alias("user"))
    return distinct.repartition(callers, "recording_key").mapInPandas(run, _CALL)


def recorded(called: DataFrame) -> DataFrame:
    """Accepted replies in the form in which they are stored for later runs."""
    return called.filter("status = 'ok'").select("recording_key", "model", "raw_response", F.current_timestamp().alias("created_at"))


# --- replies --------------------------------------------------------------------------------------
_FENCE = re.compile(r"```(?:json)?", re.I)


def first_object(reply: str | None) -> str | None:
    """The first balanced {...} of a reply (braces inside strings do not count), if it is valid JSON: as it stands, or written anew where a key
    repeats (its last value holds) or a number is not finite (it becomes a word)."""
    text = _FENCE.sub("", reply or "")
    start, odd = text.find("{"), []
    if start < 0:
        return None

    def pairs(items):
        found = dict(items)
        if len(found) < len(items):
            odd.append(items)
        return found

    def word(name):
        odd.append(name)
        return str(float(name.replace("Infinity", "inf")))
    try:
        # what is read ends where its braces balance; an object that cannot be read up to there is none
        value, end = json.JSONDecoder(object_pairs_hook=pairs, parse_constant=word).raw_decode(text, start)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if odd else text[start:end]


def well_formed(reply: str | None) -> bool:
    """The reply has an object whose aspects and claims are lists where present, and one of them is."""
    found = first_object(reply)
    value = json.loads(found) if found else {}
    lists = [value[name] for name in ("aspects", "claims") if name in value]
    return bool(lists) and all(isinstance(x, list) for x in lists)


@F.pandas_udf(T.StringType())
def _first_object(replies: pd.Series) -> pd.Series:
    return replies.map(first_object)


def with_json(replies: DataFrame, column: str = "raw_response", out: str = "json") -> DataFrame:
    """Adds the JSON object of each reply or NULL. Replies with text around the object go to Python, as do those that the JVM cannot parse.

    Spark's parser stops at the end of the first value. That nothing follows the object is known from its place in an array, where it must be
    the only element, and in another object, where no bracket can close the array early."""
    staged = settled(replies, **{column: F.col(column)})
    staged = settled(staged, _plain=strip(F.regexp_replace(column, r"(?i)```(?:json)?", "")))
    only = (F.json_array_length(F.concat(F.lit("["), "_plain", F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"o":'), "_plain", F.lit("}"))).isNotNull()
    staged = settled(staged, _whole=F.when(F.startswith("_plain", F.lit("{")) & F.endswith("_plain", F.lit("}")) & only, F.col("_plain")))
    rest = _first_object(F.when(F.col("_whole").isNull(), F.col(column)))
    return staged.withColumn(out, F.coalesce("_whole", rest)).drop("_plain", "_whole")


def _seen(v: Column) -> Column:
    """struct<kind,text>: type name and text of a field; kind is NULL when absent and VOID when null."""
    return F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"))


def _part(item: Column, name: str) -> Column:
    return let(F.try_variant_get(item, f"$.{name}", "variant"), _seen)


def _text(part: Column) -> Column:
    """The field if it is a string."""
    return F.when(part["kind"] == "STRING", part["text"])


def _empty(part: Column) -> Column:
    return F.coalesce(part["kind"] == "VOID", F.lit(True))


def _flag(part: Column, default: bool) -> Column:
    """Boolean field, also given as 0/1 or as a yes/no word; NULL when it is none of these."""
    word = F.lower(part["text"])
    return F.when(part["kind"].isNull(), F.lit(default)).when(word.isin("true", "1", "yes", "on", "t", "y"), True).when(
        word.isin("false", "0", "no", "off", "f", "n"), False)


def _items(name: str, fields: list[str], fits, shape) -> Column:
    """Items of a list that fit their shape; the fields of an item are read in one go (what is no object has none)."""
    shape_of = f"array<struct<{', '.join(f'{f}: variant' for f in fields)}>>"
    listed = F.coalesce(F.try_variant_get("_v", f"$.{name}", shape_of), F.expr(f"cast(array() as {shape_of})"))
    read = F.transform(listed, lambda i: F.struct(i.alias("item"), *[_seen(i[f]).alias(f) for f in fields]))
    return F.transform(F.filter(read, lambda p: F.coalesce(fits(p), F.lit(False))), shape)


@built_once
def _aspects() -> Column:
    return _items("aspects", ["id", "label"], lambda p: _text(p["id"]).isNotNull() & _text(p["label"]).isNotNull(),
                  lambda p: F.struct(p["id"]["text"].alias("id"), p["label"]["text"].alias("label")))


@built_once
def _claims() -> Column:
    def fits(p):
        required = _text(p["aspect"]).isNotNull() & _text(p["evidence"]).isNotNull() & _text(p["quote"]).isNotNull()
        return (required & (p["id"]["kind"].isNull() | _text(p["id"]).isNotNull()) & (_empty(p["scope"]) | _text(p["scope"]).isNotNull())
                & _flag(p["explicit"], True).isNotNull())

    def shape(p):
        value = F.when(p["value"]["kind"] == "BOOLEAN", F.initcap(p["value"]["text"])).otherwise(F.coalesce(p["value"]["text"], F.lit("")))
        kind = F.lower(F.trim(F.coalesce(p["value_type"]["text"], F.lit(""))))
        return F.struct(
            F.coalesce(p["id"]["text"], F.lit("")).alias("id"), *[p[n]["text"].alias(n) for n in ("aspect", "evidence", "quote")],
            F.when(_empty(p["value"]), "").otherwise(value).alias("value"), F.when(kind.isin(*fixed.VALUE_TYPES), kind).otherwise("text").alias("value_type"),
            _text(p["scope"]).alias("scope"), _flag(p["explicit"], True).alias("explicit"))
    return _items("claims", ["id", "aspect", "evidence", "quote", "value", "value_type", "scope", "explicit"], fits, shape)


@built_once
def _supersession() -> Column:
    return _items("supersession", ["evidence", "quote", "aspect"],
                  lambda p: _text(p["evidence"]).isNotNull() & _text(p["quote"]).isNotNull() & (_empty(p["aspect"]) | _text(p["aspect"]).isNotNull()),
                  lambda p: F.struct(p["evidence"]["text"].alias("evidence"), p["quote"]["text"].alias("quote"), _text(p["aspect"]).alias("aspect")))


@built_once
def _answer() -> Column:
    def cited(p):
        return F.try_variant_get(p["item"]["claims"], "$", "array<variant>")

    def fits(p):
        strings = F.forall(cited(p), lambda c: F.schema_of_variant(c) == "STRING")
        return _text(p["text"]).isNotNull() & (p["claims"]["kind"].isNull() | F.coalesce(strings, F.lit(False)))

    return _items("answer", ["text", "claims"], fits, lambda p: F.struct(p["text"]["text"].alias("text"), F.coalesce(
        F.try_variant_get(p["item"]["claims"], "$", "array<string>"), F.expr("cast(array() as array<string>)")).alias("claims")))


def _usable(v: Column) -> Column:
    """Aspects and claims are lists where present, and at least one of them is present."""
    def listed(name):
        return let(F.try_variant_get(v, f"$.{name}", "variant"), lambda x: F.struct(
            x.isNotNull().alias("present"), F.try_variant_get(x, "$", "array<variant>").isNotNull().alias("listed")))
    fits = let(F.struct(listed("aspects").alias("a"), listed("claims").alias("c")), lambda x: (
        (~x["a"]["present"] | x["a"]["listed"]) & (~x["c"]["present"] | x["c"]["listed"]) & (x["a"]["listed"] | x["c"]["listed"])))
    return F.coalesce(fits, F.lit(False))


def validated(replies: DataFrame, json_column: str = "json") -> DataFrame:
    """Adds `valid` and the items that fit: aspects, claims, supersession, answer, ambiguous, ambiguity_note."""
    # a filter on `valid` is not pushed below these, so a reply is parsed once, and not once per mention
    rows = settled(replies, _v=F.try_parse_json(json_column))
    rows = settled(rows, valid=let(F.col("_v"), _usable)).withColumn("_v", F.when(F.col("valid"), F.col("_v")))
    flag, note = _part(F.col("_v"), "ambiguous"), _part(F.col("_v"), "ambiguity_note")
    # any text that is not empty counts as yes, the word "false" too
    said = F.when(flag["kind"] == "STRING", flag["text"] != "").otherwise(~flag["text"].isin("false", "0", "[]", "{}", "0.0"))
    ambiguous = F.coalesce(~_empty(flag) & said, F.lit(False))
    return rows.withColumns({"aspects": _aspects(), "claims": _claims(), "supersession": _supersession(), "answer": _answer(),
                             "ambiguous": ambiguous, "ambiguity_note": _text(note)}).drop("_v")


@built_once
def _own_claims() -> Column:
    return F.transform("claims", lambda c, i: F.struct(
        (i + 1).cast("int").alias("claim_no"), F.concat(F.lit("C"), (i + 1).cast("string")).alias("claim_id"),
        let(F.array_position("_aspect_ids", c["aspect"]), lambda p: F.when(p > 0, F.concat(F.lit("A"), p.cast("string"))).otherwise("")).alias("aspect_id"),
        *[c[f].alias(f) for f in ("evidence", "quote", "value", "value_type", "scope", "explicit")]))


@built_once
def _own_answer() -> Column:
    def own(c):
        return let(F.array_position("_claim_ids", c), lambda p: F.when((p > 0) & (c != ""), F.concat(F.lit("C"), p.cast("string"))))
    return F.transform("answer", lambda s: F.struct(s["text"].alias("text"), F.filter(F.transform(s["claims"], own), lambda c: c.isNotNull()).alias("claims")))


@built_once
def _own_entries() -> Column:
    return F.transform("supersession", lambda e, i: F.struct(
        (i + 1).cast("int").alias("entry_no"), e["evidence"].alias("evidence"), e["quote"].alias("quote"),
        let(F.array_position("_aspect_ids", e["aspect"]), lambda p: F.when(p > 0, F.concat(F.lit("A"), p.cast("string")))).alias("aspect_id")))


def reissued(replies: DataFrame) -> DataFrame:
    """Own ids A1.. and C1..; the first of equal ids wins and every reference follows it."""
    rows = replies.withColumns({"_aspect_ids": F.transform("aspects", lambda a: a["id"]), "_claim_ids": F.transform("claims", lambda c: c["id"])})
    aspects = F.transform("aspects", lambda a, i: F.struct(
        (i + 1).cast("int").alias("aspect_no"), F.concat(F.lit("A"), (i + 1).cast("string")).alias("aspect_id"), a["label"].alias("label")))
    rows = rows.withColumns({"own_aspects": aspects, "own_claims": _own_claims(), "own_answer": _own_answer(), "own_entries": _own_entries()})
    return rows.drop("_aspect_ids", "_claim_ids", "aspects", "claims", "answer", "supersession").withColumnsRenamed(
        {"own_aspects": "aspects", "own_claims": "claims", "own_answer": "answer", "own_entries": "entries"})


def rule_claims(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stand-in for the model: a claim for every evidence passage of the question that holds the fact's quote.

    facts: question_id, fact_no, label, quote, value, value_type; evidence: question_id, eid, rank, text.
    """
    return facts.join(evidence.select("question_id", "eid", "rank", "text"), "question_id").filter(F.contains("text", "quote")).select(
        "question_id", "fact_no", "label", F.col("eid").alias("evidence"), "rank", "quote", "value", "value_type",
        F.lit(None).cast("string").alias("scope"), F.lit(True).alias("explicit"))
