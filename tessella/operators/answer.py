"""From hits to citations, context, prompt and answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename

NO_MATCH = "No relevant documents found."
PROMPT = (
    "Answer the question from the numbered documents in the context and from nothing else, in few and exact words.\n"
    "Cite the documents that you draw on by their numbers in square brackets, like [1] or [2].\n"
    "If the context doesn't hold the answer, say so politely.\n\nContext:\n"
)


def citations(hits: DataFrame) -> DataFrame:
    """index, text, source, page_number of ranked hits."""
    page = F.col("page_num").cast("string") if "page_num" in hits.columns else F.lit(None).cast("string")
    return hits.select(F.col("rank").alias("index"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce(page, F.lit("?")).alias("page_number"))


def numbered_context(cited: DataFrame) -> DataFrame:
    """One row: `[index] text` and a blank line for each citation in order. Citations are at most k."""
    rows = F.array_sort(F.collect_list(F.struct("index", "text")))
    return cited.agg(F.array_join(F.transform(rows, lambda x: F.concat(F.lit("["), x["index"].cast("string"), F.lit("] "), x["text"], F.lit("\n\n"))), "").alias("context"))


def prompt_for(context: Column, question: str) -> Column:
    return F.concat(F.lit(PROMPT), context, F.lit(f"\nQuestion:\n{question}\n"))


def only_selected(cited: DataFrame, selected: list[str]) -> DataFrame:
    """Citations whose file is among the selected ones, by base name; numbers keep their gaps."""
    return cited.where(basename(F.col("source")).isin(*[s.rsplit("/", 1)[-1] for s in selected]))


def checked_question(question: str) -> str:
    if not question or not question.strip():
        raise ValueError("a question is required")
    return question


def extractive(prompt: str) -> str:
    """The offline stand-in for a language model: the first numbered document, cited."""
    context = prompt.partition("Context:\n")[2].partition("\nQuestion:")[0]
    first = context.partition("\n\n")[0].strip()
    return f"{first[4:].split('. ')[0]} [1]" if first.startswith("[1]") else "The context does not say."


def ask(hits: DataFrame, question: str, model: Callable[[str], str] = extractive) -> dict:
    """answer_with_refs, citations and error. Hits are at most k, so they come to the driver."""
    cited = citations(hits).orderBy("index").collect()
    if not cited:
        return {"answer_with_refs": NO_MATCH, "citations": [], "error": None}
    prompt = PROMPT + "".join(f"[{r['index']}] {r['text']}\n\n" for r in cited) + f"\nQuestion:\n{checked_question(question)}\n"
    try:
        answer, error = model(prompt).strip(), None
    except Exception as e:  # the answer holds the failure, as callers show it
        answer, error = f"The model failed: {e}", str(e)
    return {"answer_with_refs": answer, "citations": [r.asDict() for r in cited], "error": error}
