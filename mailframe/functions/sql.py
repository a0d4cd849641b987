"""SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mailframe import schema
from mailframe.functions.text import INVISIBLE, INVISIBLE_ENTITIES, NBSP


def register(spark: SparkSession) -> list[str]:
    """Register the functions for SQL; gives their names.

    mail_decode(binary) and mail_html(string) give the structs of schema.MIME and schema.HTML; the others are SQL expressions that the
    optimizer sees through. mail_quoted_at gives the place of the first header of a quoted reply, 0 if there is none.
    """
    from mailframe.operators import anonymize, html, mime, quotes

    spark.udf.register("mail_decode", F.arrow_udf(mime._arrow, schema.MIME))
    spark.udf.register("mail_html", F.arrow_udf(html._arrow, schema.HTML))
    removed = "s"
    for e in INVISIBLE_ENTITIES:
        removed = f"replace({removed}, '{e}', '')"
    text = {
        "mail_clean_invisible": f"translate({removed}, '{NBSP}{INVISIBLE}', ' ')",
        "mail_trim": r"regexp_replace(s, r'(?U)\A\s+|\s+\z', '')",
        "mail_collapse_newlines": r"regexp_replace(s, r'\n{3,}', chr(10) || chr(10))",
        "mail_mask_emails": f"regexp_replace(s, r'{anonymize.EMAIL}', '{anonymize.EMAIL_PLACEHOLDER}')",
    }
    urls, tokens = "s", "s"
    for pattern, to in anonymize.URL_RULES:
        urls = f"regexp_replace({urls}, {_literal(pattern + anonymize._REST)}, '{to}')"
    for pattern, groups, to in anonymize.TOKENS:
        tokens = f"regexp_replace({tokens}, {_literal(pattern)}, '{''.join(f'${i}' for i in groups)}{to}')"
    text["mail_mask_urls"], text["mail_mask_tokens"] = urls, tokens
    text["mail_quoted_at"] = f"regexp_instr(s, {_literal(quotes.ANY_HEADER)}, 0)"
    for name, body in text.items():
        kind = "INT" if name == "mail_quoted_at" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    return ["mail_decode", "mail_html", *text]


def _literal(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
