"""Template residue and error-page text: records that were never finished or are no content at all.

A record is residue if it holds an unfilled slot, filler, the message of an error page or a notice that scripts or cookies must be
allowed. Lines are counted in normal form by host. A line that recurs in a large part of a host's records is furniture of the host and
is subtracted: what is left, the residual, is searched record by record. What was subtracted is searched too, but as a text of its own and once for
all records that hold the same furniture, since an error page or a notice is evidence however often it recurs. So recurrence moves work
and keeps furniture and own text from being read as one sentence; it never hides evidence, and the
verdict on a record doesn't depend on how many others there are. Text that merely speaks of such things doesn't match: the patterns ask for the form such messages
take (addressed to the reader, opening a sentence, naming a status), and brackets or braces count only with a slot's content.
Filler in made-up words is told by its form: a long run of words without one function word of any listed language, drawn from few words.

Cases: null or empty text holds no evidence. Null host: nothing is subtracted. Equal records of a host get equal verdicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut, small_side


@dataclass(frozen=True)
class ResidueConfig:
    #: a line is furniture of its host in at least this many and this share of the host's records
    min_records: int = 20
    min_share: float = 0.2


#: a slot ends in its paragraph; paragraphs are parted by an empty line, two blanks once lines are joined
_SAME = r"(?!\n\n|  )"
_NAME = rf"[A-Za-z](?:{_SAME}[\w .\-])*?"
_INSERT = r"[\[(]\s*(?:insert|fill in|enter|add|type|specify|supply)\s"
_SLOTS = [
    # any expression, but no set of sets ('{{1, 2}, {3}}')
    rf"\{{\{{(?!\s*\w+\s*,)(?=[^{{}}]*\w)(?:{_SAME}(?:[^{{}}]|\{{(?:{_SAME}[^{{}}])*\}}))+\}}\}}", rf"\{{%(?![^\w%]*%\}})(?:{_SAME}(?!%\}}|\{{%)[\s\S])+%\}}", rf"<%(?![^\w%]*%>)(?:{_SAME}(?!%>|<%)[\s\S])+%>",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    r"%\([A-Za-z]\w*\)[sdf]\b", r"%%[A-Za-z][\w ]*%%", r"@@[A-Za-z][\w ]*@@", r"(?<![A-Za-z0-9])__[A-Za-z][A-Za-z0-9_]*?__(?![A-Za-z0-9])",
    rf"<<\s*{_NAME}\s*>>", rf"«{_NAME}»", rf"\[\[\s*{_NAME}\s*\]\]", rf"&lt;\s*[a-z](?:{_SAME}[a-z _])+\s*&gt;",
    rf"<[A-Za-z](?:{_SAME}[A-Za-z ])+\shere>",
    rf"{_INSERT}(?:{_SAME}(?!{_INSERT})[^\])])+[\])]", rf"\[(?:{_SAME}[^\][])+\sto\s(?:come|follow|be (?:added|confirmed|determined|supplied))\]",
    r"\[\s*(?:tbd|tba|tbc|tk|todo|to be determined|n\.?n\.?|x{2,}|[●•∙·]|_{2,}|\.{3,}|…)\s*\]", r"\$\s?\[\s*_*\s*\]",
    r"\bx{2}[/.-]x{2}[/.-](?:x{2,4}|\d\dx\dx?|\d\dxx)\b", r"\b(?:19|20)xx\b",
]
_THING = r"(?:page|files?|filing|report|exhibit|document|section|text|paragraph|heading|headline|caption|summary|title|copy|content|chapter|article|site|viewer|reader|tables?|description|body copy|view|resource|url|address)"
_FILLER = [
    r"\blorem\s+ipsum\b", r"\b(?:dummy|placeholder|filler)\s(?:copy|text|content)\b",
    rf"\b(?:put|insert|place|type|add|write|enter)\s(?:(?:your|a|an|the|some)\s)?(?:short\s|brief\s)?{_THING}\b[^.\n]{{0,40}}?\b(?:here\b|in\sthis\s(?:box|space|field))",
    rf"\byour\s{_THING}\s(?:goes\s)?(?:here\b|in\sthis\s(?:box|space|field))", rf"\b{_THING}\sgoes\shere\b",
    rf"(?:^|(?<=[.!?:]\s)|(?<=\n))(?:sample|example)\s{_THING}(?:\s\d+)?\s?(?:[.!]|$)",
    rf"\breplace\sthis\s{_THING}\b", r"\bcontent\scoming\ssoon\b", r"\bstub\screated\sby\b", r"\btodo\b[^.\n]{0,40}\b(?:write|todo|fix|add|fill)\b",
    r"(?:\bx{2,}\b[\s,.]*){4,}", r"\basdf(?:\s+(?:asdf|jkl|qwer|qwerty)\b)+",
    r"\bvotre\stexte\sici\b", r"(?:^|[.!?]\s|\n)à\sremplacer\b", r"\bhier\ssteht\sihr\stext\b", r"(?:^|[.!?]\s|\n)bitte\sersetzen\b", r"\b(?:escriba|inserte|ponga)\saquí\b", r"\btexto\sde\sejemplo\b", r"\b(?:texte|text)\s(?:d[’']exemple|beispieltext)\b", r"\bblindtext\b", r"\bbeispieltext\b",
]
_STATUS = (
    r"(?:not\sfound|forbidden|bad\srequest|unauthori[sz]ed|sign-?in\srequired|login\srequired|request\stim(?:ed\sout|eout)|gone|too\smany\srequests|(?:internal\s)?server\serror|"
    r"bad\sgateway|service\s(?:temporarily\s)?unavailable|gateway\stim(?:ed\sout|e-?out)|access\sdenied|payload\stoo\slarge|method\snot\sallowed|page\sexpired|página\sno\sencontrada|page\s(?:introuvable|non\strouvée)|seite\snicht\sgefunden|nicht\sgefunden|no\sencontrad[oa]|introuvable)"
)
_OPEN = r"(?:^|(?<=\n)|(?<=[.!?:]\s)|(?<=[-–>]\s))"
_ERROR = [
    rf"{_OPEN}(?:http|error|erreur|fehler|status)\s?:?\s?[45]\d\d\b(?!\s(?:minutes|hours|days))", rf"\b[45]\d\d\s?[-–:.]?\s?{_STATUS}", rf"{_STATUS}\s?\((?:code|error|http|status)\s?:?\s?[45]\d\d\)",
    rf"{_OPEN}(?:{_STATUS})(?=\s?(?:$|\n|[.!:?]|\s[-–]\s))", rf"{_OPEN}(?:error|erreur|fehler)(?=\s?(?:$|\n|[.!]))",
    rf"\b{_THING}\syou\s(?:requested|asked\sfor|were\slooking\sfor|are\slooking\sfor)\b[^.\n]{{0,20}}\b(?:not|n[’']t|removed|moved)\b",
    rf"\b(?:we|server|viewer|site)\s(?:couldn[’']t|could\snot|can[’']t|cannot|were\sunable\sto)\s(?:find|show|open|load|display)\s(?:that|this|the|your)\s{_THING}\b",
    rf"\bthe\slink\sto\sthis\s{_THING}\sis\sbroken\b", rf"\bthis\s{_THING}\s(?:was\sremoved\sor\s|has\sbeen\sremoved|is\sno\slonger\savailable|has\sexpired|could\snot\sbe\s(?:found|loaded))",
    rf"\byour\saccess\sto\s(?:the|this)\s{_THING}\s", r"\byou\sare\snot\s(?:allowed|authori[sz]ed|permitted)\sto\s(?:view|open|see|read|access)\b", r"\byou\s(?:lack|do\snot\shave|don[’']t\shave)\s(?:the\s)?permission\sto\b",
    rf"{_OPEN}access\s(?:is\s|was\s)?(?:denied|blocked)\b(?=\s?(?:$|\n|[:.!]|\sfor\s\d))", r"\byour\ssession\s(?:has|is|was)?\s?(?:timed\sout|expired)\b", r"\bvotre\ssession\sa\sexpiré\b", r"\bsu\ssesión\sha\s(?:caducado|expirado)\b", r"\bihre\ssitzung\sist\sabgelaufen\b",
    r"\bunexpected\s(?:fault|error)\s(?:stopped|prevented|occurred)\b", r"\bsomething\swent\swrong\son\sour\b", r"\brequest\scould\snot\sbe\s(?:completed|processed)\b", r"\bthe\sserver\stook\stoo\slong\b", r"\bconnection\sto\s(?:the\s)?database\sfailed\b",
    r"\btraceback\b[^\n]{0,30}\b\w*error\b", r"\bkeyerror\sin\b", r"\bupstream\ssent\sno\sanswer\b", r"\b(?:viewer|site|page|server)\sis\sdown\sfor\smaintenance\b", r"\btry\sagain\slater\sor\sgo\sback\sto\b", r"\btoo\smany\srequests\sfrom\syour\b",
    r"\baccès\srefusé\b", r"\bacceso\sdenegado\b", r"\bzugriff\sverweigert\b", r"\berreur\sinterne\b", r"\berror\sinterno\b", r"\binterner\sserverfehler\b",
]
_S = r"(?:java\s?scripts?|js|(?:active\s)?script(?:s|ing)|cookies)"
_SS = rf"{_S}(?:\s(?:and|&|or)\s{_S})?"
_ON = r"(?:enable|activate|allow|permit|accept|switch\son|turn\son)"
_SCRIPT = [
    rf"\b(?:please|kindly)\s(?:\w+\s){{0,2}}?{_ON}\s(?:\w+\s){{0,3}}?{_SS}\b", rf"\byou\s(?:must|need\sto|have\sto|should|will\sneed\sto)\s{_ON}\s(?:\w+\s){{0,3}}?{_SS}\b",
    rf"\byour\sbrowser\s(?:does\snot\s(?:support|allow|run)|doesn[’']t\s(?:support|allow|run)|has\s(?:blocked|switched\soff|disabled|turned\soff)|blocks|is\sblocking)\s(?:\w+\s){{0,2}}?{_SS}\b",
    rf"\b(?:page|site|viewer|reader|app|website|application)\s(?:needs|requires|does\snot\swork\swithout|doesn[’']t\swork\swithout|cannot\s(?:start|work|run|load)\swithout|can[’']t\s(?:start|work|run|load)\swithout|will\snot\swork\swithout|relies\son)\s{_SS}\b",
    rf"{_OPEN}{_SS}\s(?:is\s|are\s)?(?:disabled|blocked|off|missing|required|turned\soff|switched\soff)(?=\s?(?:$|\n|[.?!,]|\sin\syour))", rf"{_OPEN}{_SS}\s(?:must|have\sto|need\sto)\sbe\s(?:allowed|enabled|activated|switched\son)\b",
    rf"\bif\snothing\sappears\b", rf"{_OPEN}{_ON}\s(?:\w+\s)?{_SS}\b", r"\bchecking\syour\sbrowser\sbefore\b",
    r"\b(?:aktivieren|erlauben|schalten)\ssie\s(?:bitte\s)?(?:javascript|js|cookies|skripte)\b", r"\b(?:javascript|cookies|skripte)\s(?:ist|sind)\s(?:deaktiviert|blockiert|ausgeschaltet)\b", r"\b(?:veuillez|merci\sd[e’'])\s?(?:activer|autoriser|accepter)\s(?:les\s)?(?:javascript|js|cookies|scripts)\b",
    r"\b(?:javascript|cookies|scripts)\s(?:est|sont)\s(?:désactivés?|bloqués?)\b", r"\b(?:active|activa|habilite|permita|acepte)\s(?:las?\s|los\s)?(?:javascript|js|cookies|scripts)\b", r"\b(?:javascript|cookies|scripts)\s(?:está|están)\s(?:desactivad[oa]s?|bloquead[oa]s?)\b",
]


_REPEATS = [r"\b(\w{1,14})(?:[\s,.]+\1\b){4,}", r"\b(\w{1,14})\s+(\w{1,14})(?:\s+\1\s+\2\b){3,}"]


def _compile(parts: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in parts), re.IGNORECASE)


#: (kind, pattern, pieces of lower-case text with single blanks of which one must be there for the pattern to match): most records need no pattern at all.
PATTERNS: list[tuple[str, re.Pattern, tuple[str, ...]]] = [
    ("slot", _compile(_SLOTS), ("{", "<", "«", "[", "%%", "%(", "@@", "__", "&lt;", "xx", *(f"({blank}{verb} " for verb in ("insert", "fill in", "enter", "add", "type", "specify", "supply") for blank in ("", " ")))),
    ("filler", _compile(_FILLER), (
        "lorem", "dummy", "placeholder", "filler", "here", "in this box", "in this space", "in this field", "sample", "example", "replace this", "coming soon", "stub created", "todo", "xx", "asdf",
        "votre texte", "remplacer", "hier steht", "ersetzen", "aquí", "ejemplo", "exemple", "blindtext", "beispieltext")),
    ("error", _compile(_ERROR), (
        "http", "status", "error", "erreur", "fehler", "not found", "forbidden", "bad request", "unauthor", "sign-in", "signin", "sign in", "login", "timed out", "timeout", "time-out", "gone", "too many requests", "server", "gateway", "unavailable",
        "denied", "expired", "expiré", "blocked", "encontrad", "introuvable", "non trouv", "gefunden", "you requested", "you asked for", "looking for", "couldn't ", "couldn’t ", "could not ", "cannot find", "cannot show", "cannot open", "cannot load", "cannot display", "can't ", "can’t ", "unable to", "is broken", "removed", "no longer",
        "your access", "you are not", "permission", "caducado", "expirado", "abgelaufen", "unexpected", "went wrong", "took too long", "database", "upstream", "maintenance", "try again", "refusé", "denegado", "verweigert", "interne", "interno", "too large", "not allowed")),
    ("script", _compile(_SCRIPT), ("script", "js", "cookie", "skript", "nothing appears", "checking your")),
]
_REPEAT = _compile([_REPEATS[0]]), _compile([_REPEATS[1]])
#: the commonest articles, prepositions, conjunctions, pronouns and auxiliaries of English, French, German, Spanish, Italian, Portuguese and Dutch
_FUNCTION_WORDS = frozenset((
    "a an the of to in on at by for from with as and or but if that this which it its we our they their is are was were be been has have had not no than "
    "le la les un une des du de et ou en au aux par pour sur dans avec que qui est sont ne pas se sa son ses nous nos "
    "der die das den dem ein eine einen einer und oder von vom zu zum zur mit auf bei für im am als auch ist sind war nicht sich wir unser unsere "
    "el los las una y o del al con por para su sus es son no se lo como más nuestro nuestra nuestros "
    "il gli di e che per non i lo alla della sono ha um os uma do da dos das em não ao het een van op te dat voor"
).split())
MADE_UP_WORDS, MADE_UP_VARIETY = 12, 0.8
_POINTS = str.maketrans(dict.fromkeys(".,;:!?", " "))
#: the piece 'here' counts as a word only ('there' and 'where' are in most texts)
_HERE = re.compile(r"\bhere\b")
_BREAK = re.compile(r"[ \t\r]*\n[ \t]*(?:>+[ \t]*)?")


def views(text: str) -> tuple[str, str]:
    """The text with its lines, and with wrapped lines joined; both without quotation marks of replies, emphasis and repeated blanks."""
    lined = text.replace("\u200b", "").replace("\u00a0", " ").replace("\t", " ")
    if "\n" in lined:
        lined = _BREAK.sub("\n", lined)
    if "*" in lined:
        lined = re.sub(r"\*(?=\S)|(?<=\S)\*", "", lined)
    while "  " in lined:
        lined = lined.replace("  ", " ")
    lined = lined.lstrip("> ").rstrip()
    return lined, lined.replace("\n", " ")


def _repeated(low: str) -> str | None:
    words = low.split()
    if any(x == y for x, y in zip(words, words[1:])) and (m := _REPEAT[0].search(low)):
        return m.group()
    if any(x == y and p == q for x, y, p, q in zip(words, words[2:], words[1:], words[3:])) and (m := _REPEAT[1].search(low)):
        return m.group()
    return None


def _made_up(low: str) -> str | None:
    """A run of at least MADE_UP_WORDS words, none of them a function word and at most MADE_UP_VARIETY of them different."""
    words = low.translate(_POINTS).split()
    ends = [i for i, w in enumerate(words) if w in _FUNCTION_WORDS or not w.isalpha()]
    for first, end in zip([-1, *ends], [*ends, len(words)]):
        if end - first > MADE_UP_WORDS and len(set(run := words[first + 1 : end])) <= MADE_UP_VARIETY * len(run):
            return " ".join(run)
    return None


def evidence(text: str | None) -> tuple[str, str] | None:
    """(kind, matching passage) of the first evidence found, else None."""
    if not text:
        return None
    # pieces may be spread over wrapped lines
    both = views(text)
    low = " ".join(both[1].lower().split())
    live = [(kind, pattern) for kind, pattern, pieces in PATTERNS if any(p in low and (p != "here" or _HERE.search(low)) for p in pieces)]
    if (found := _repeated(low) or _made_up(low)) is not None:
        return "filler", found[:200]
    if live:
        for view in dict.fromkeys(both):
            for kind, pattern in live:
                if m := pattern.search(view):
                    return kind, m.group()[:200]
    return None


def _forms(text: Column) -> Column:
    """Identifiers of the normal forms of the non-empty lines, in order."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), "[ \t\r]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.xxhash64(F.trim(x)))


def furniture(docs: DataFrame, cfg: ResidueConfig = ResidueConfig()) -> DataFrame:
    """(host, lines): identifiers of the lines that recur through a host; at most 1 / min_share times the lines of a record each."""
    known = docs.where("host is not null and text is not null")
    lines = known.select("host", F.explode(F.array_distinct(_forms(F.col("text")))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("k")).where(F.col("k") >= cfg.min_records)
    sizes = known.groupBy("host").agg(F.count("*").alias("n"))
    often = lines.join(sizes, "host").where(F.col("k") >= cfg.min_share * F.col("n"))
    return often.groupBy("host").agg(F.collect_set("line").alias("lines"))


def residual(docs: DataFrame, cfg: ResidueConfig = ResidueConfig()) -> DataFrame:
    """(id, text, recurring): the records without their host's furniture, and the furniture they hold (null: none).

    Blank lines are never furniture. A furniture line next to a line of the record's own stays in the text as well, since both may be one wrapped sentence.
    """
    known = docs.join(small_side(cut(furniture(docs, cfg))), "host", "left")
    # most records hold no furniture and pass as they are; lines and forms are zipped, so that the forms of a text are made once
    zipped = F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.col("_f").alias("form"))
    marked = F.transform(zipped, lambda s: F.struct(s["line"].alias("line"), (F.trim(s["line"]) == "").alias("blank"), F.array_contains("lines", s["form"]).alias("often")))
    own = lambda x: ~x["blank"] & ~x["often"]
    beside = lambda i: F.coalesce(own(F.get("_l", i)), F.lit(False))
    kept = F.filter("_l", lambda x, i: x["blank"] | ~x["often"] | beside(i - 1) | beside(i + 1))
    gone = F.filter("_l", lambda x: ~x["blank"] & x["often"])
    text_of = lambda a: F.array_join(F.transform(a, lambda x: x["line"]), "\n")
    formed = known.select("id", "text", "lines", F.when(F.col("lines").isNotNull(), _forms(F.col("text"))).alias("_f"))
    lined = formed.select("id", "text", F.when(F.arrays_overlap("_f", "lines"), marked).alias("_l"))
    return lined.select("id", F.when(F.col("_l").isNull(), F.col("text")).otherwise(text_of(kept)).alias("text"), F.when(F.size(gone) > 0, text_of(gone)).alias("recurring"))


def residue(docs: DataFrame, cfg: ResidueConfig = ResidueConfig()) -> DataFrame:
    """(id, kind, passage) of the records of (id, host, text) that hold evidence."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judged = lru_cache(maxsize=10_000)(evidence)
        for pdf in it:
            rows = [(i, *e) for i, t, r in zip(pdf["id"], pdf["text"], pdf["recurring"]) if (e := evidence(t) or judged(r))]
            yield pd.DataFrame(rows, columns=["id", "kind", "passage"])

    return residual(docs.where("text is not null"), cfg).mapInPandas(run, "id bigint, kind string, passage string")
