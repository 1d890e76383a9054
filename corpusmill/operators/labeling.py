"""Labelling by a language model: prompts, calls with keys in turn, responses, quality control."""

from __future__ import annotations

import json
import math
import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from corpusmill.operators.qc import QcConfig, run_qc, source_text
from corpusmill.sources.store import appended, remove, written

# The prompt.
PROMPT_VERSION = "1.2.0"
CONTENT_CHARS = 6000
#: Bytes of text that one labelling task reads.
TASK_BYTES = 64_000_000
SYSTEM_PROMPT = """Bạn là biên tập viên báo chí tiếng Việt. Tóm tắt phải:
- Trung thực 100% với bài gốc; KHÔNG suy diễn, KHÔNG bịa số liệu hay tên riêng.
- 2-3 câu, tổng cộng 40-70 từ.
- Văn phong báo chí, trung lập, không cảm thán, không câu hỏi.
- Giữ nguyên tên riêng, số liệu, ngày tháng đúng như bài gốc.
- Nếu thông tin không đủ rõ, viết câu trung lập, KHÔNG bổ sung từ kiến thức ngoài."""
USER_PROMPT = '''Tiêu đề: {title}
Chuyên mục: {category}
Nguồn: {source}

Nội dung:
"""
{content_text}
"""

Trả về JSON đúng schema:
{
  "summary": "...",
  "key_entities": ["..."],
  "confidence": 0.0,
  "refusal_reason": null
}'''
# The model that is asked where none is named, and how it generates.
MODELS = ("gemini-3.1-flash-lite",)
GENERATION = {"temperature": 0.2, "top_p": 0.9, "max_output_tokens": 4096, "response_mime_type": "application/json"}

#: A model call: (system prompt, user prompt) to the raw response.
Generate = Callable[[str, str], str]
LABEL_SCHEMA = StructType([StructField("summary", StringType()), StructField("key_entities", ArrayType(StringType())), StructField("confidence", DoubleType()), StructField("refusal_reason", StringType()), StructField("error", StringType())])


def truncated(content: Column, chars: int = CONTENT_CHARS) -> Column:
    """Content of at most `chars` characters; longer ones end at the last blank before, with a mark."""
    head = F.substring(content, 1, chars)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(content) > chars, F.concat(cut, F.lit(" [...]"))).otherwise(content)


def render_prompt(title: Column, category: Column, source: Column, content: Column, chars: int = CONTENT_CHARS) -> Column:
    some = lambda c: F.coalesce(c, F.lit(""))
    values = {"title": some(title), "category": some(category), "source": some(source), "content_text": truncated(some(content), chars)}
    # Literal text stands at even places, names of values at odd ones.
    parts = re.split("{(" + "|".join(values) + ")}", USER_PROMPT)
    return F.concat(*(values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)))


def parse_label(raw: str | None) -> dict:
    """The fields of a response, or its error. Control characters in strings are let through.

    A confidence above 1 is 1. Null is a summary only beside a refusal reason. What is no
    object, misses a field or has one of a wrong type is an error, never a crash.
    """
    bad = lambda why: {"summary": "", "key_entities": [], "confidence": 0.0, "refusal_reason": why, "error": why}
    try:
        data = json.loads(raw or "", strict=False)
    except json.JSONDecodeError as e:
        return bad(f"LLM did not return valid JSON: {e}")
    if not isinstance(data, dict):
        return bad("LLM JSON does not match schema: not an object")
    summary, refusal = data.get("summary"), data.get("refusal_reason")
    summary = "" if summary is None and refusal else summary
    names, confidence = data.get("key_entities", []), data.get("confidence", 0.0)
    if isinstance(confidence, int | float) and confidence > 1:
        confidence = 1.0
    if isinstance(confidence, str):
        try:
            confidence = float(confidence)
        except ValueError:
            confidence = None
    wrong = [
        name
        for name, ok in (
            ("summary", isinstance(summary, str)),
            ("key_entities", isinstance(names, list) and all(isinstance(x, str) for x in names)),
            ("confidence", isinstance(confidence, int | float) and not math.isnan(confidence) and 0 <= confidence <= 1),
            ("refusal_reason", refusal is None or isinstance(refusal, str)),
        )
        if not ok
    ]
    if wrong:
        return bad(f"LLM JSON does not match schema: {', '.join(wrong)}")
    return {"summary": summary, "key_entities": names, "confidence": float(confidence), "refusal_reason": refusal, "error": None}


@F.pandas_udf(LABEL_SCHEMA)
def parse_labels(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_label(x) for x in raw], columns=["summary", "key_entities", "confidence", "refusal_reason", "error"])


# Words of an error message that tell its kind, looked for in this order.
ERROR_KINDS = (
    ("transient", ("429", "resource has been exhausted", "quota", "rate limit", "rate_limit", "too many requests", "deadline", "unavailable", "internal", "timeout", "503", "500")),
    ("unavailable", ("not found", "does not exist", "invalid")),
)


def error_kind(message: str) -> str:
    low = message.lower()
    return next((kind for kind, words in ERROR_KINDS if any(w in low for w in words)), "fatal")


class LabelError(RuntimeError):
    pass


class TransientLabelError(LabelError):
    pass


#: Held while a labeler takes its turn; not part of it, since labelers travel to tasks.
TURN = threading.Lock()


class RotatingLabeler:
    """Calls models with keys in turn.

    call(model, key, system, user) returns text. Transient errors go to the next key, an
    unavailable model to the next model, others end the call; if all fail and any was
    transient, the whole is tried again up to `attempts` times, after 2 to 60 seconds. Threads
    share one turn; a task starts with a key of its own, so tasks do not all start with the first.
    """

    def __init__(self, call: Callable[[str, str, str, str], str | None], keys: list[str], models: list[str], attempts: int = 6, sleep: Callable[[float], None] = time.sleep):
        if not keys:
            raise ValueError("no API key")
        self.call, self.keys, self.models, self.attempts, self.sleep, self.at = call, list(keys), list(models), attempts, sleep, None

    def in_turn(self) -> list[str]:
        with TURN:
            if self.at is None:
                context = TaskContext.get()
                self.at = context.partitionId() if context else 0
            start = self.at % len(self.keys)
            self.at += 1
        return self.keys[start:] + self.keys[:start]

    def once(self, system: str, user: str) -> str:
        transient, last = False, ""
        for model in self.models:
            for key in self.in_turn():
                try:
                    text = self.call(model, key, system, user)
                except Exception as e:  # noqa: BLE001 the client's errors are known by their text only
                    last, kind = str(e), error_kind(str(e))
                    if kind == "transient":
                        transient = True
                        continue
                    if kind == "unavailable":
                        break
                    raise LabelError(last) from e
                if text is None:
                    raise LabelError("empty response")
                return text
        raise (TransientLabelError if transient else LabelError)(last or "all models failed")

    def __call__(self, system: str, user: str) -> str:
        for k in range(self.attempts):
            try:
                return self.once(system, user)
            except TransientLabelError:
                if k + 1 == self.attempts:
                    raise
                self.sleep(min(60, 2 * 2**k))
        raise LabelError("no attempts")


def api_keys(env: Mapping[str, str]) -> list[str]:
    """Keys of GEMINI_API_KEYS, parted by commas, else the one of GEMINI_API_KEY."""
    many = [k.strip() for k in env.get("GEMINI_API_KEYS", "").split(",") if k.strip()]
    one = [k for k in [env.get("GEMINI_API_KEY", "").strip()] if k]
    if not (many or one):
        raise ValueError("no API key")
    return many or one


def gemini_call(model: str, key: str, system: str, user: str) -> str | None:
    """One call of the hosted models; the client library must be installed where tasks run."""
    from google import genai

    found = genai.Client(api_key=key).models.generate_content(model=model, contents=f"{system}\n\n{user}", config=GENERATION)
    return found.text


def call_model(prompts: DataFrame, generate: Generate) -> DataFrame:
    """prompts(..., user_prompt) with raw and call_error; an error of a call is its row's error."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, errors = [], []
            for user in b.column("user_prompt"):
                try:
                    raw.append(generate(SYSTEM_PROMPT, user.as_py()))
                    errors.append(None)
                except (LabelError, ValueError) as e:
                    raw.append(None)
                    errors.append(str(e))
            yield b.append_column("raw", pa.array(raw, pa.string())).append_column("call_error", pa.array(errors, pa.string()))

    return prompts.mapInArrow(run, columns + ", raw string, call_error string")


def waves(rows: DataFrame, tasks: int) -> Iterator[DataFrame]:
    """rows in parts of `tasks` partitions, to be run one after the other, so that at most `tasks` run at once and none reads much over TASK_BYTES."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in ("title", "content_text")), F.lit(0).cast("bigint"))
    n = -(-(rows.agg(F.sum(size)).first()[0] or 0) // (tasks * TASK_BYTES))
    if n <= 1:
        yield rows.repartition(tasks)
        return
    dealt, path = written(rows.repartition(n * tasks), "dealt-rows")
    files = sorted(dealt.inputFiles())
    for k in range(0, len(files), tasks):
        yield rows.sparkSession.read.schema(dealt.schema).parquet(*files[k : k + tasks]).coalesce(tasks)
    remove(rows.sparkSession, path)


def label_rows(rows: DataFrame, generate: Generate, concurrency: int = 5, limit: int | None = None, cfg: QcConfig = QcConfig()) -> DataFrame:
    """rows(article_id, title, category, source, content_text, ...) with the seven label columns, by article_id.

    At most `concurrency` calls run at once, in as many tasks as that at a time, of bounded
    size. Answers are written before anything reads them,
    so however often the result is computed, a row's model is asked once; only a task that
    fails asks again. Label columns that exist are replaced. Failed calls and bad responses
    give rows that failed quality control with the reason.
    """
    if limit is not None:
        rows = rows.orderBy("article_id").limit(limit)
    prompt = render_prompt(F.col("title"), F.col("category"), F.col("source"), F.col("content_text"))
    answers = appended((call_model(part.withColumn("user_prompt", prompt), generate) for part in waves(rows, max(concurrency, 1))), "answers")
    called = answers.withColumn("_l", parse_labels("raw"))
    error = F.coalesce("call_error", "_l.error")
    fields = {"summary": F.regexp_replace("_l.summary", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), "key_entities": F.col("_l.key_entities"), "confidence": F.col("_l.confidence"), "refusal_reason": F.coalesce("call_error", "_l.refusal_reason"), "_error": error, "source_text": source_text(F.col("title"), F.col("content_text"))}
    checked = run_qc(called.withColumns(fields), cfg)
    kind = checked.schema["qc_details"].dataType.simpleString()
    failed = F.struct(F.lit(False).alias("passed"), F.array(F.concat(F.lit("label_error:"), F.col("_error"))).alias("reasons"), *(F.lit(None).alias(c) for c in ("word_count", "sentence_count", "missing_numbers", "missing_entities"))).cast(kind)
    bad = F.col("_error").isNotNull()
    out = checked.withColumns({"qc_passed": F.col("qc_passed") & ~bad, "qc_details": F.when(bad, failed).otherwise(F.col("qc_details")), "prompt_version": F.lit(PROMPT_VERSION)})
    return out.drop("user_prompt", "raw", "call_error", "_l", "_error", "source_text").orderBy("article_id")
