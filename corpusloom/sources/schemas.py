"""Declared schemas of what is read, and assertions on what is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType



def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TEXT, NUMBER, FLAG, TEXTS = StringType(), IntegerType(), BooleanType(), ArrayType(StringType())
WORD_ENTRY = _struct(
    id=TEXT, headword=TEXT, display_headword=TEXT, section=TEXT, date_label=TEXT, plain_text=TEXT,
    paragraphs=ArrayType(_struct(text=TEXT)), related_targets=TEXTS, source_pages=TEXTS,
)
_SIDE = _struct(primary=TEXT, follow_ups=TEXTS, tokens=_struct(primary=TEXTS))
CARD_BOOK = _struct(
    id=TEXT, kind=TEXT, ordinal=TEXT, source=_struct(language=TEXT, primary=TEXT, follow_ups=TEXTS), source_hash=TEXT,
    languages=_struct(en=_SIDE, ja=_SIDE, zh=_SIDE), evidence=_struct(pdf_page=TEXT, epub_member=TEXT),
)
MORPHOLOGY = _struct(id=TEXT, headword=TEXT, cells=TEXTS, source_page=TEXT)
WRITTEN = ArrayType(_struct(text=TEXT, common=FLAG, appliesToKanji=TEXTS))
_SENSE = _struct(appliesToKanji=TEXTS, appliesToKana=TEXTS, partOfSpeech=TEXTS, gloss=ArrayType(_struct(lang=TEXT, text=TEXT)))
JMDICT = _struct(words=ArrayType(_struct(id=TEXT, kanji=WRITTEN, kana=WRITTEN, sense=ArrayType(_SENSE))))
SECTIONS = ArrayType(_struct(heading=TEXT, level=NUMBER, line_start=NUMBER, line_end=NUMBER, excerpt=TEXT))
LINKS = ArrayType(_struct(target=TEXT, label=TEXT))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all the columns; an error that names the missing ones if not."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
