"""Prompts and reply schemas of the tutoring tasks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import not_blank

# The wording of the prompts.
OPENING = "You are a patient, encouraging tutor running entirely offline on the student's own device."
LENGTH_RULE = "Keep answers under 200 words unless asked for more."
HONESTY_RULE = "Use simple language and a concrete example. Never invent facts; if you are unsure, say so plainly."
STYLES = {
    "socratic": "Do NOT explain the whole concept at once. Reply in at most 3 sentences: give one small hint, then end with a question that makes the student think. Your reply MUST end with a question mark. Give the full answer only if the student asks for it directly.",
    "direct": "Answer clearly and immediately, then add one short worked example.",
    "exam_prep": "Be concise and exam-focused. Give the answer, the marking points, and one common mistake to avoid.",
}
CORRECTION = 'That reply explained too much. My question was: "%s". Rewrite your reply in at most 2 sentences, strictly about that question: one small hint, then ONE question back to me. Your whole reply must end with a question mark. Do not give the answer. Do not change the subject.'
EXPLAIN_SYSTEM = "You are a tutor explaining a topic to a %s student. Reply in %s. Use plain language, no markdown, and no letter prefixes."
EXPLAIN_USER = "Explain: %s\nReturn:\n1. summary: 2-3 sentences a %s student understands.\n2. key_points: 3 to 5 short bullet facts.\n3. analogy: one everyday comparison.\n4. check_question: one question to test understanding."
QUIZ_SYSTEM = "You write multiple-choice quiz questions for a %s student. Exactly one option is correct. Do not prefix options with letters or numbers. Copy the correct option into `answer` word for word, exactly as it appears in `options`."
QUIZ_USER = "Topic: %s\nWrite %s %s multiple-choice questions with exactly %s options each. Every question must be answerable from the topic alone. Add a one-sentence explanation of why the correct option is right."
GRADE_SYSTEM = "Grade a %s student's answer.\nis_anything_wrong: true if the student said anything factually false.\nIf is_anything_wrong is true -> verdict 'incorrect', score below 40.\nElse if the key idea is there -> 'correct', score 85-100.\nElse -> 'partially_correct', score 40-84.\nNever agree with a false statement."

EXPLAIN_REPLY = "summary string, key_points array<string>, analogy string, check_question string"
QUIZ_REPLY = "questions array<struct<question:string,options:array<string>,answer:string,explanation:string>>"
GRADE_REPLY = "is_anything_wrong boolean, verdict string, score_int int, feedback string, hint string"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def style_rule(style: Column) -> Column:
    """The rule of a style; unknown and missing styles are socratic."""
    rules = F.create_map(*(F.lit(x) for pair in STYLES.items() for x in pair))
    return F.coalesce(F.try_element_at(rules, F.coalesce(style, F.lit("socratic"))), F.lit(STYLES["socratic"]))


def system_prompt(subject: Column, level: Column, name: Column, language: Column, style: Column) -> Column:
    return F.concat_ws(
        " ",
        F.lit(OPENING),
        F.concat(F.lit("Subject: "), not_blank(subject), F.lit(".")),
        F.concat(F.lit("The student's level is: "), not_blank(level), F.lit(". Match your vocabulary to it.")),
        F.concat(F.lit("The student's name is "), not_blank(name), F.lit(".")),
        F.lit(LENGTH_RULE),
        F.lit(HONESTY_RULE),
        F.concat(F.lit("Reply in "), F.coalesce(not_blank(language), F.lit("English")), F.lit(".")),
        F.concat(F.lit("Most important rule: "), style_rule(style)),
    )


def chat_messages(history: Column, system: Column) -> Column:
    return F.concat(F.array(message("system", system)), history)


def retry_messages(base: Column, reply: Column, question: Column) -> Column:
    return F.concat(base, F.array(message("assistant", reply), message("user", F.format_string(CORRECTION, question))))


def explain_messages(topic: Column, level: Column, language: Column) -> Column:
    return F.array(message("system", F.format_string(EXPLAIN_SYSTEM, level, language)), message("user", F.format_string(EXPLAIN_USER, topic, level)))


def quiz_messages(topic: Column, questions: Column, options: Column, difficulty: Column, level: Column) -> Column:
    text = F.format_string(QUIZ_USER, topic, questions.cast("string"), difficulty, options.cast("string"))
    return F.array(message("system", F.format_string(QUIZ_SYSTEM, level)), message("user", text))


def grade_messages(question: Column, answer: Column, expected: Column, level: Column) -> Column:
    text = F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.concat(F.lit("Student answer: "), answer), F.concat(F.lit("Reference answer: "), not_blank(expected)), F.lit("Grade the student answer."))
    return F.array(message("system", F.format_string(GRADE_SYSTEM, level)), message("user", text))
