"""XML as text."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from .base import col, cols, python


@cols
def xmltext(s):
    s = F.replace(s.cast("string"), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xmlelement(name: str, *content, **attributes):
    """An element; attributes by keyword, content already XML (see xmltext) or null for none."""
    given = [F.concat(F.lit(f' {k}="'), F.replace(xmltext(v), F.lit('"'), F.lit("&quot;")), F.lit('"')) for k, v in attributes.items()]
    inner = F.concat_ws("", *map(col, content)) if content else F.lit("")
    start = F.concat(F.lit(f"<{name}"), *given)
    return F.when(inner == "", F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">"), inner, F.lit(f"</{name}>")))


def xmlforest(**values):
    return F.concat_ws("", *[F.when(col(v).isNotNull(), F.concat(F.lit(f"<{k}>"), xmltext(v), F.lit(f"</{k}>"))) for k, v in values.items()])


def _well_formed(content: bool):
    def value(text):
        try:
            ET.fromstring(f"<r>{text}</r>" if content else text)
        except ET.ParseError:
            return False
        return True

    value.__name__ = "well_formed"
    return python("boolean")(value)


def to_xml(df, table: str, columns: list[str] | None = None):
    """Rows of df as <row> elements; text nulls are left out. One text per row; sort and join them for a document."""
    names = columns or df.columns
    return df.select(F.concat(F.lit("<row>"), xmlforest(**{c: F.col(c) for c in names}), F.lit("</row>")).alias(table))


FUNCTIONS = {
    "xml": cols(lambda x: x.cast("string")),
    "xmlcomment": cols(lambda s: F.concat(F.lit("<!--"), s, F.lit("-->"))),
    "xmlconcat": lambda *a: F.nullif(F.concat_ws("", *map(col, a)), F.lit("")),
    "xmlconcat2": lambda *a: F.nullif(F.concat_ws("", *map(col, a)), F.lit("")),
    "xmlelement": xmlelement,
    "xmlforest": xmlforest,
    "xmltext": xmltext,
    "__xmlparse": lambda text: F.when(_well_formed(True)(text), col(text)).otherwise(F.raise_error(F.lit("invalid XML content"))),
    "xmlexists": lambda path, text: F.size(F.xpath(col(text), F.lit(path))) > 0,
    "xpath": lambda path, text: F.xpath(col(text), F.lit(path)),
    "xpath_exists": lambda path, text: F.xpath_boolean(col(text), F.lit(path)),
    "xml_is_well_formed": _well_formed(True),
    "xml_is_well_formed_content": _well_formed(True),
    "xml_is_well_formed_document": _well_formed(False),
    "table_to_xml": to_xml,
    "query_to_xml": to_xml,
}
