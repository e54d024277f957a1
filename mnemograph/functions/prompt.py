"""Prompt fragments and request bodies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTION_INSTRUCTION = (
    "Read the chat turn and list lasting facts as one JSON array and nothing else. Each element has subjectName, "
    "objectName (or null), predicate, factText and isCorrection (true if it takes back something known before). "
    "Name people by name, never by pronoun. Leave out what only holds at the moment. No facts: an empty array."
)


def section(header: str, context: Column) -> Column:
    """Header and context, or nothing for a null or empty context."""
    return F.when(F.coalesce(context, F.lit("")) == "", "").otherwise(F.concat(F.lit(header + "\n"), context))


def memory_section(context: Column) -> Column:
    return section("What you remember about the user and their world:", context)


def knowledge_section(context: Column) -> Column:
    return section("Reference knowledge for this question:", context)


def identity_preamble(name: Column, personality: Column, now: Column) -> Column:
    """Who the assistant is, and when it speaks."""
    when = F.date_format(now, "EEEE, MMMM d, y 'at' h:mm a")
    return F.concat(F.lit("You are "), name, F.lit(". "), personality, F.lit("\nIt is "), when, F.lit("."))


def rerank_prompt(query: Column, candidates: Column) -> Column:
    """A numbered list of candidates with the question that they are to be ordered by."""
    numbered = F.array_join(F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    return F.concat(F.lit("Order these facts by how well they help with: "), query, F.lit("\n"), numbered, F.lit("\nAnswer with a JSON array of their numbers."))


def chat_role(role: Column) -> Column:
    """The role name of the remote chat service."""
    return F.when(role == "assistant", "model").otherwise("user")


def generate_body(system: Column, messages: Column, cached_content: Column) -> Column:
    """JSON request; ``messages`` is array<struct<role, text>>. A cached name stands in for the system instruction."""
    contents = F.transform(messages, lambda m: F.struct(chat_role(m["role"]).alias("role"), F.array(F.struct(m["text"].alias("text"))).alias("parts")))
    instruction = F.when(cached_content.isNull(), F.struct(F.array(F.struct(system.alias("text"))).alias("parts")))
    return F.to_json(F.struct(contents.alias("contents"), cached_content.alias("cachedContent"), instruction.alias("systemInstruction")))
