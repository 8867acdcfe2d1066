"""One character form for texts that look the same.

Three steps.  Characters: invisible ones go, spaces and hyphens of one look are
made one, full-width forms, ligatures and the font's private Thai marks become
the usual letters.  Thai clusters: marks of a consonant stand in one order,
split vowels are one letter.  Scripts: the dominant script of a token is that of
the letters no other script shows; look-alikes of other scripts in it are
replaced by its own, only where the word that results occurs, in one script, in
the corpus.  The vocabulary stays a table: only the suspect words are joined
with it.

Tokens whose letters all have look-alikes have no letter that tells the script;
they are read as Latin, and so are those that are wholly in another script, as
they look the same as the Latin word.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.expansion import expanded
from loomfold.sources.shared import checkpoint

#: Private-use marks of the books' fonts and the Thai marks they show.
FONT_MARKS = {
    0xF700: 0x0E10, 0xF701: 0x0E34, 0xF702: 0x0E35, 0xF703: 0x0E36, 0xF704: 0x0E37,
    0xF705: 0x0E48, 0xF706: 0x0E49, 0xF707: 0x0E4A, 0xF708: 0x0E4B, 0xF709: 0x0E4C,
    0xF70A: 0x0E48, 0xF70B: 0x0E49, 0xF70C: 0x0E47, 0xF70D: 0x0E4B, 0xF70E: 0x0E4C,
    0xF70F: 0x0E0D, 0xF710: 0x0E31, 0xF711: 0x0E4D, 0xF712: 0x0E47, 0xF713: 0x0E48,
    0xF714: 0x0E49, 0xF715: 0x0E4A, 0xF716: 0x0E4B, 0xF717: 0x0E4C, 0xF718: 0x0E38,
    0xF719: 0x0E39, 0xF71A: 0x0E3A,
}
#: Cyrillic and Greek letters that look like Latin ones, pairwise.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіѕјһԁԛԝ" "АВЕКМНОРСТХЅІЈҮ" "νο" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxisjhdqw" "ABEKMHOPCTXSIJY" "vo" "ABEZHIKMNOPTYX",
        strict=True,
    )
)
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]
_SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_SIMPLE = (
    {c: None for c in _INVISIBLE}
    | {c: " " for c in _SPACES}
    | {0x2010: "-", 0x2011: "-"}
    | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
    | dict(zip(range(0xFB00, 0xFB07), ("ff", "fi", "fl", "ffi", "ffl", "st", "st"), strict=True))
    | {k: chr(v) for k, v in FONT_MARKS.items()}
)
_MARKS = re.compile("[ัิ-ฺ็-๎]{2,}")
#: Runs of marks that are not in order already.
_MISPLACED = re.compile("[่-๋][ัิ-ฺ็ํ]|[์๎][ัิ-ฺ็-๋ํ]|ํ[ัิ-ฺ็]|[ัิ-ฺ็]{2}|[่-๋]{2}|[์๎]{2}|ํํ")
_OTHER = re.compile("[^\x00-\x7f\u0e00-\u0e7f]")
_SPLIT_AM = re.compile("([่-๋]?)ํ([่-๋]?)า")
_LINE_END = re.compile(r"[ \t]*\r?\n|\r")
_LETTERS = re.compile("[A-Za-zÀ-ɏ\u0300-\u036f\u0370-\u03ff\u0400-\u052f]+")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]")
LATIN, GREEK, CYRILLIC = 0, 1, 2


def _script(c: str) -> int | None:
    """The script of a letter; combining marks belong to any."""
    o = ord(c)
    return GREEK if 0x370 <= o < 0x400 else CYRILLIC if 0x400 <= o < 0x530 else None if 0x300 <= o < 0x370 else LATIN


#: For each script the letters that show as a letter of another script, and what they are in this one.
_INTO = {s: {} for s in (LATIN, GREEK, CYRILLIC)}
for _c, _l in LOOK_ALIKES.items():
    _INTO[LATIN][_c] = _l
    _INTO[_script(_c)].setdefault(_l, _c)
for _c, _l in LOOK_ALIKES.items():
    for _d, _m in LOOK_ALIKES.items():
        if _l == _m and _script(_c) != _script(_d):
            _INTO[_script(_d)].setdefault(_c, _d)
_SHARED = set(LOOK_ALIKES) | set(LOOK_ALIKES.values())


def _order(m: re.Match) -> str:
    """Vowels before tone marks before the mark that silences; a mark shows once."""
    rank = lambda c: 2 if "่" <= c <= "๋" else 3 if c in "์๎" else 1 if c == "ํ" else 0
    return "".join(dict.fromkeys(sorted(m.group(), key=lambda c: (rank(c), unicodedata.combining(c), c))))


def plain_form(text: str) -> str:
    """The text after the steps on characters and Thai clusters.  Its digits, letters, tone
    marks and case are as before; ends of lines lose white space that nobody sees."""
    if text.isascii():
        t = text
    else:
        other = bool(_OTHER.search(text))
        t = unicodedata.normalize("NFC", text.translate(_SIMPLE)) if other else text
        for _ in range(8):
            t = t.replace("เเ", "แ")
            if _MISPLACED.search(t):
                t = _MARKS.sub(_order, t)
            if "ํ" in t:
                t = _SPLIT_AM.sub(r"\1\2ำ", t)
            composed = unicodedata.normalize("NFC", t) if other else t
            # composition may bring marks together that other marks kept apart
            if composed == t:
                break
            t = composed
    return _LINE_END.sub("\n", t).rstrip()


def reading(word: str) -> str | None:
    """The word in its dominant script: the one most of its letters belong to that no other script
    shows, Latin where it has none.  None where it is in that script already, or a letter of
    another script has no look-alike there."""
    letters = unicodedata.normalize("NFD", word)
    scripts = [_script(c) for c in letters]
    sure = Counter(s for c, s in zip(letters, scripts, strict=True) if s is not None and c not in _SHARED)
    main = max((LATIN, GREEK, CYRILLIC), key=lambda s: sure[s])
    if all(s is None or s == main for s in scripts):
        return None
    out = [c if s is None or s == main else _INTO[main].get(c) for c, s in zip(letters, scripts, strict=True)]
    return None if None in out else unicodedata.normalize("NFC", "".join(out))


def suspects(plain: str) -> dict[str, str]:
    """Words of ``plain`` with letters of another than their dominant script, and their readings in it."""
    if not _FOREIGN.search(plain):
        return {}
    return {w: r for w in set(_LETTERS.findall(plain)) if _FOREIGN.search(w) and (r := reading(w))}


def repair_words(plain: str, repairs: dict[str, str]) -> str:
    """``plain`` with the words of ``repairs`` replaced."""
    return _LETTERS.sub(lambda m: repairs.get(m.group(), m.group()), plain) if repairs else plain


def _one_script(word: str) -> bool:
    return word.isascii() or not _FOREIGN.search(word) or len({_script(c) for c in word} - {None}) == 1


_SIGNS = pa.schema([("src", pa.string()), ("id", pa.int64()), ("look", pa.binary()), ("stored", pa.binary()), ("words", pa.list_(pa.struct([("word", pa.string()), ("reading", pa.string())]))), ("known", pa.list_(pa.string()))])
_SIGNS_DDL = "src string, id long, look binary, stored binary, words array<struct<word: string, reading: string>>, known array<string>"


def _signs(rows: DataFrame) -> DataFrame:
    """One pass over the texts: ``(src, id, look, stored, words)``, hashes of the text with every
    suspect word in its reading and of the text as stored, and the suspect words; and rows without
    ``look`` that hold in ``known`` the words of one script that a task has met."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        met: set[str] = set()

        def known() -> pa.RecordBatch:
            words = [w for w in met if _one_script(w)]
            met.clear()
            return pa.RecordBatch.from_pylist([{"src": None, "id": None, "look": None, "stored": None, "words": [], "known": words}], _SIGNS)

        for batch in batches:
            out = []
            for src, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                p = plain_form(t)
                met.update(_LETTERS.findall(p))
                if p.strip():
                    s = suspects(p)
                    out.append({"src": src, "id": i, "look": sign(repair_words(p, s)), "stored": sign(t), "words": [{"word": w, "reading": r} for w, r in sorted(s.items())], "known": []})
            yield pa.RecordBatch.from_pylist(out, _SIGNS)
            if len(met) > 100_000:
                yield known()
        yield known()

    return rows.select("src", "id", "text").filter("text IS NOT NULL").mapInArrow(run, _SIGNS_DDL)


def _repairs(signs: DataFrame) -> DataFrame:
    """``(word, reading)``: the suspect words whose reading the corpus has."""
    known = signs.select(F.explode("known").alias("reading")).distinct()
    return signs.select(F.explode("words").alias("w")).select("w.word", "w.reading").distinct().join(known, "reading", "left_semi")


def repairs_of(rows: DataFrame) -> DataFrame:
    """``(word, reading)``: the suspect words of all rows whose reading the corpus has."""
    return _repairs(checkpoint(_signs(rows).select("words", "known")))


def look_classes(rows: DataFrame) -> DataFrame:
    """``(src, id, look, stored, kept)``: rows look the same where ``look`` and ``kept`` are
    equal; ``kept`` holds the suspect words whose reading the corpus does not have."""
    every = checkpoint(_signs(rows))
    signs = every.filter("look IS NOT NULL").drop("known")
    plain, odd = signs.filter("size(words) = 0"), signs.filter("size(words) > 0")
    none = F.array().cast("array<string>")
    known = odd.select("src", "id", F.explode("words.word").alias("word")).join(_repairs(every), "word", "left")
    kept = known.groupBy("src", "id").agg(F.sort_array(F.collect_set(F.when(F.col("reading").isNull(), F.col("word")))).alias("kept"))
    return plain.select("src", "id", "look", "stored", none.alias("kept")).unionByName(odd.join(kept, ["src", "id"]).select("src", "id", "look", "stored", "kept"))


def same_look(rows: DataFrame) -> DataFrame:
    """``(src, id_a, id_b)``, id_a < id_b: rows of one source whose texts differ as stored and
    look the same.

    ``rows`` has ``src, id, text``.  Null, empty and blank texts are no case.  The
    forms of one look are compared once each, then carried to their rows; rows of
    the same form never meet.
    """
    forms, members, pairs = look_pairs(rows)
    both = expanded(pairs, members)
    src = forms.select(F.col("form").alias("a"), "src")
    return both.join(src, "a").select("src", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def look_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(form, src)``: the forms in which texts are stored; ``(form, id)``: the rows of each;
    ``(a, b)``: the forms that look the same.  A form is one hash, whatever the number of its copies."""
    classes = checkpoint(look_classes(rows).withColumn("form", F.sha2(F.concat(F.col("src").cast("binary"), F.col("stored")), 256)))
    forms = classes.select("src", "look", "kept", "form").distinct()
    pairs = forms.alias("x").join(forms.alias("y"), ["src", "look", "kept"]).filter("x.form < y.form").select(F.col("x.form").alias("a"), F.col("y.form").alias("b"))
    return forms.select("form", "src"), classes.select(F.col("form").alias("cls"), "id"), pairs


def canonical_text(rows: DataFrame) -> DataFrame:
    """``(src, id, text)``: each text in the canonical form; null stays null."""
    fixed = repairs_of(rows)

    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [None if t is None else plain_form(t) for t in batch.column(2).to_pylist()]
            words = [sorted(suspects(p)) if p else [] for p in forms]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string()), pa.array(words, pa.list_(pa.string()))], ["src", "id", "text", "words"])

    done = rows.select("src", "id", "text").mapInArrow(plain, "src string, id long, text string, words array<string>")
    odd = done.filter("size(words) > 0")
    per = odd.select("src", "id", F.explode("words").alias("word")).join(fixed, "word").groupBy("src", "id").agg(F.collect_list(F.struct("word", "reading")).alias("fix"))

    def mend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [repair_words(t, {x["word"]: x["reading"] for x in f or []}) for t, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["src", "id", "text"])

    mended = odd.join(per, ["src", "id"], "left").select("src", "id", "text", "fix").mapInArrow(mend, "src string, id long, text string")
    return done.filter("size(words) = 0").select("src", "id", "text").unionByName(mended)
