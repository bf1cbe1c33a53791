"""Broken prompt and response pairs: empty, truncated, refusal, copied prompt, other language.

Prompt and response are aligned as word sequences: the share of the response's word shingles that the prompt
holds and, where that is high, the longest common subsequence tell a copy; the alignment of the response with
refusal templates tells a refusal. All work is per pair, in Arrow batches; nothing is shuffled but the verdicts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import spread


SHINGLE = 5
#: At least this share of the response's shingles in the prompt makes it a candidate copy.
COPY_SHINGLES = 0.7
#: A copy has at least this share of its words in the common subsequence, which holds this share of the prompt.
COPY_WORDS, COPY_PROMPT = 0.9, 0.6
#: At least this share of a template's words, in order, in so many words of a sentence for each of them, is a refusal.
REFUSED, SPAN = 0.8, 3

#: What declining sounds like; a sentence that holds a template's words in their order is aligned with it.
TEMPLATES = {
    "en": [
        "i can't help with that",
        "i cannot help with this",
        "i can't assist with that",
        "i cannot assist with",
        "i am unable to help with",
        "i am unable to give an answer",
        "i'm not able to help with",
        "i won't be able to comply with this",
        "i will not answer",
        "i won't answer",
        "i do not feel comfortable naming",
        "i don't feel comfortable answering",
        "i must decline",
        "i have to decline",
        "i decline to answer",
        "i refuse to answer",
        "i cannot comply with this",
        "i can't comply with this",
        "i cannot provide an answer",
        "i can't provide an answer",
        "i cannot answer this",
        "i can't answer this",
        "answering this is outside of what i'm allowed",
        "i am not allowed to answer",
        "i'm not permitted to answer",
        "this request goes against my guidelines",
        "against my guidelines",
        "violates my guidelines",
    ],
    "de": [
        "dabei kann ich nicht helfen",
        "dazu darf ich keine auskunft geben",
        "ich kann dir dabei nicht helfen",
        "ich kann ihnen dabei nicht helfen",
        "das darf ich nicht beantworten",
        "ich darf diese frage nicht beantworten",
        "ich kann diese anfrage nicht bearbeiten",
        "diese anfrage kann ich nicht beantworten",
        "diese anfrage muss ich ablehnen",
        "ich muss diese anfrage ablehnen",
        "ich muss das ablehnen",
        "es ist mir nicht erlaubt",
    ],
    "es": [
        "no puedo ayudar con",
        "no puedo ayudarte con",
        "no me está permitido responder",
        "debo rechazar esta solicitud",
        "tengo que rechazar esta",
        "no puedo responder a esta",
        "no puedo responder a esto",
        "no estoy autorizado a responder",
        "no puedo atender esta solicitud",
    ],
    "fr": [
        "je ne peux pas vous aider",
        "je ne peux pas t'aider",
        "je ne peux pas répondre à cette",
        "je dois refuser de répondre",
        "je dois refuser",
        "il ne m'est pas permis de",
        "je ne suis pas autorisé à",
        "je refuse de répondre",
        "je ne suis pas en mesure de répondre",
    ],
}

#: Function words by language.
WORDS = {
    "en": "the a an and of to in is are was were be been has have had not no nothing with for on at by from that this these those it its as or if than when which while there we they you who so yet only but because after before still mostly each every nobody must may can cannot could should does do their our depends out most them he she his her how what why".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder nicht ist sind war waren wird werden wurde mit für auf aus bei nach von vom zu zum zur im in an am als auch noch nur wenn dass damit deshalb ohne darf kann muss hat haben hatte wir ihr sie es er keine kein keinen niemand jede jeder jedes diesem dieser diese dieses davon daran nichts hängt ab wieder sich über unter einige mehr vorher einen um so".split(),
    "es": "el la los las un una unos unas y o no es son era fue ha han hemos se que de del al a en con sin por para porque como también más pero si su sus nadie nada puede pueden debe deben este esta estos estas ello ella él lo le les algunos así cada antes después todo todos quedan hay depende dependa ni ya".split(),
    "fr": "le la les un une des du de d' l' et ou ne pas n' est sont était étaient a ont avons nous vous il elle ils elles qui que qu' dans en par pour sur avec sans car donc aussi plus aucune aucun chaque personne peut doit être ce cet cette ces au aux son sa ses leur se s' après avant rien tout tous été jamais plusieurs encore si mais y".split(),
    "pt": "o a os as um uma uns umas e ou não é são foi era há se que de do da dos das no na nos nas ao aos à em com sem por para porque como também mais mas sua seu ninguém nada pode podem deve devem este esta estes estas nesta neste dele dela isso outras outros cada antes depois todo todos ser precisa novamente depende alguns já".split(),
    "it": "il lo la i gli le un uno una e o non è sono era erano ha hanno abbiamo si che di del dello della dei degli delle da dal dalla in nel nella con senza per su sul sulla perché come anche più ma se suo sua nessuno niente nulla può possono deve devono questo questa questi queste ci altre altri ogni prima dopo tutto tutti essere da dipende alcuni già".split(),
    "nl": "de het een en of niet is zijn was waren wordt worden werd met voor op uit bij na van naar te in aan als ook nog maar alleen wanneer dat omdat zonder mag kan moet heeft hebben had we wij hij zij geen niemand niets elke deze dit die er over onder meer opnieuw om door".split(),
    "pl": "i w na z do nie jest są był była było się że to ten ta te tego tej które który która przez dla po przed bez może musi nikt nic każdy każda jak ale lub oraz od za tylko gdy".split(),
    "sv": "och att det som en ett är var den de i på av för med till inte om har hade kan måste ingen inget varje utan efter före eller men från vid när också".split(),
    "da": "og at det som en et er var den de i på af for med til ikke om har havde kan skal ingen intet hver uden efter før eller men fra ved når også".split(),
    "cs": "a v na z do ne je jsou byl byla bylo se že to ten ta které který která pro po před bez může musí nikdo nic každý každá jak ale nebo od za jen když".split(),
    "tr": "ve bir bu için ile de da ne değil olan olarak gibi daha çok her hiç kimse sonra önce veya ama kadar var yok ise".split(),
}
_LANGUAGES_OF: dict[str, set[str]] = {}
for _language, _list in WORDS.items():
    for _word in _list:
        _LANGUAGES_OF.setdefault(_word, set()).add(_language)
_SCRIPTS = [("ru", r"[Ѐ-ӿ]"), ("ja", r"[぀-ヿ]"), ("zh", r"[一-鿿]"), ("ko", r"[가-힯]"), ("ar", r"[؀-ۿ]"), ("el", r"[Ͱ-Ͽ]"), ("he", r"[֐-׿]"), ("hi", r"[ऀ-ॿ]"), ("th", r"[฀-๿]")]
_SCRIPTS = [(k, re.compile(v)) for k, v in _SCRIPTS]

_WORD = re.compile(r"\w+(?:['’]\w+)*")
_FENCE = re.compile(r"(?m)^[ \t>]*(`{3,}|~{3,})[^\n`]*$")
_PATH = re.compile(r"(?<![\w.@~-])[\w.@~-]*(?:[/\\][\w.@~()\[\]*+-]+)+")
_ID = re.compile(r"\b[A-Z]{1,4}-\d+\b")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|‘[^’]*’|`[^`]*`|\\?\"[^\"\n]*\"")
_CODE = re.compile(r"(?<!\w)\w*[_.\d]\w+(?:\.\w+)*|\b[a-z]+[A-Z]\w*")
_HOLLOW = re.compile(r"`{3,}[A-Za-z]*|~{3,}[A-Za-z]*")
_HOLLOW_CHARS = frozenset("\"'`´“”„‟«»‹›‘’‚‛[](){}<>（）［］｛｝「」『』〈〉《》【】＂＇⠀ㅤᅟᅠ￼")


def words(text: str) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(text.casefold())]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over the longer text."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def is_empty(reply: str | None) -> bool:
    if reply is None:
        return True
    rest = _HOLLOW.sub("", reply)
    return all(c.isspace() or c in _HOLLOW_CHARS or not c.isprintable() or "︀" <= c <= "️" for c in rest)


def _documents(text: str) -> tuple[list, str, bool]:
    """JSON values in the text, the text around them, and whether one breaks off."""
    decoder, values, around, i, broken = json.JSONDecoder(strict=False), [], [], 0, False
    while True:
        m = re.compile(r"[{\[]").search(text, i)
        if not m:
            around.append(text[i:])
            return values, " ".join(around), broken
        j = m.start()
        around.append(text[i:j])
        try:
            value, i = decoder.raw_decode(text, j)
            values.append(value)
        except ValueError:
            if text[j] == "{" and re.compile(r"\{\s*(\"|$)").match(text, j) or text[j] == "[" and re.compile(r"\[\s*(\"(?:[^\"\\]|\\.)*\"\s*[,\]]|\{)").match(text, j):
                broken = True
                around.append(text[j:])
                return values, " ".join(around), broken
            around.append(text[j])
            i = j + 1
        except RecursionError:
            around.append(text[j:])
            return values, " ".join(around), broken


def _strings(value) -> Iterator[str]:
    """Running text in a JSON value."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)


def language(text: str) -> tuple[str, int, dict[str, int]]:
    """The likely language of the running text, its count of evidence, and the counts of all."""
    bare = _CODE.sub(" ", _ID.sub(" ", _PATH.sub(" ", _QUOTED.sub(" ", text))))
    if not bare.isascii():
        scores = {k: len(p.findall(bare)) for k, p in _SCRIPTS}
        if scores["ja"]:
            scores["ja"] += scores["zh"]
        best = max(scores, key=scores.get)
        if scores[best] and scores[best] * 2 > len(re.findall(r"[^\W\d_]", bare)):
            return best, scores[best], scores
    counts = dict.fromkeys(WORDS, 0)
    for t in re.findall(r"[^\W\d_]+['’]?", bare.casefold()):
        t = t.replace("’", "'")
        known = _LANGUAGES_OF.get(t, _NONE)
        if t[-1] == "'":
            known = known | _LANGUAGES_OF.get(t[:-1], _NONE)
        for k in known:
            counts[k] += 1
    best = max(counts, key=lambda k: (counts[k], k))
    return best, counts[best], counts


_NONE: frozenset[str] = frozenset()
_TEMPLATES = [words(t) for ts in TEMPLATES.values() for t in ts]


def is_refusal(prose: str) -> bool:
    """Whether a sentence, however long, holds a template somewhere."""
    for sentence in re.split(r"[.!?。\n;]+", prose.replace("’", "'")):
        w = words(sentence)
        held = set(w)
        for t in _TEMPLATES:
            need = max(3, REFUSED * len(t))
            if sum(x in held for x in t) < need:
                continue
            own, span = set(t), SPAN * len(t)
            starts = [i for i, x in enumerate(w) if x in own] if len(w) > span else [0]
            if any(lcs(t, w[i : i + span]) >= need for i in starts):
                return True
    return False


def is_copy(prompt: list[str], reply: list[str]) -> bool:
    if not prompt or not reply:
        return False
    if len(reply) < SHINGLE:
        return False
    grams = {tuple(prompt[i : i + SHINGLE]) for i in range(len(prompt) - SHINGLE + 1)}
    own = [tuple(reply[i : i + SHINGLE]) for i in range(len(reply) - SHINGLE + 1)]
    if sum(g in grams for g in own) < COPY_SHINGLES * len(own):
        return False
    common = lcs(prompt, reply)
    return common >= COPY_WORDS * len(reply) and common >= COPY_PROMPT * len(prompt)


def breaks_off(reply: str, broken_json: bool) -> bool:
    """Whether the reply ends in the middle of its JSON, a word or a sentence."""
    if broken_json:
        return True
    text = reply.rstrip().rstrip("​﻿ ")
    fences = _FENCE.findall(text)
    last = text.rsplit("\n", 1)[-1].strip()
    if len(fences) % 2 and not last.endswith(("}", "]")):
        return True
    if not last or _FENCE.match(last) or last.endswith(("```", "~~~")):
        return False
    item = re.match(r"(?:[-*+•>]|\d+[.)])(?:\s+|$)(.*)$", last)
    if item:
        body = item.group(1).strip().strip("`\"'")
        if not body:
            return True
        if _PATH.fullmatch(body):
            return not re.search(r"\.(?:tsx?|jsx?|py|go|java|c|h|cc|cpp|cxx|hpp|sql|ya?ml|json|md|txt|\*)$", body) and not body.endswith("*")
        if re.fullmatch(r"[A-Z]{1,4}-?\d*", body):
            return not re.fullmatch(r"[A-Z]{1,4}-\d{2,}", body)
        if re.fullmatch(r"[\w.-]+", body) and "." in body:
            return False
        last = body
    end = last.rstrip("\"'`”’»)]}*_ ")
    return not (end.endswith((".", "!", "?", "…", "。", "！", "？", "؟", "।")) or last.endswith(("}", "]", '"'))) or end.endswith(" -")


def defect(prompt: str | None, reply: str | None) -> str | None:
    """The defect of a pair, or None. A missing prompt can be copied by nothing and has no language."""
    if is_empty(reply):
        return "empty"
    asked = prompt or ""
    values, around, broken = _documents(reply)
    strings = [s for v in values for s in _strings(v)]
    prose = _HOLLOW.sub(" ", around) + "\n" + "\n".join(strings)
    told = [x for v in values if isinstance(v, dict) for x in v.values() if isinstance(x, list)]
    answers = any(told) or bool(_PATH.search(reply)) or bool(_ID.search(reply))
    if not answers and is_refusal(prose):
        return "refusal"
    w_prompt, w_reply = words(asked), words(re.sub(r"\\[ntr]", " ", reply))
    if not told and is_copy(w_prompt, w_reply):
        return "copied_prompt"
    if breaks_off(reply, broken):
        return "truncated"
    lang_p, n_p, _ = language(asked)
    plain = "\n".join(s for s in [around, *strings] if not (_PATH.fullmatch(s.strip()) or _ID.fullmatch(s.strip())))
    first = asked.strip().split("\n", 1)[0].strip()
    if first:
        plain = plain.replace(first, " ")
    lang_r, n_r, counts = language(plain)
    if n_p and n_r and lang_r != lang_p:
        own = counts.get(lang_p, 0)
        if n_r >= 2 and n_r >= 1.5 * own:
            return "other_language"
    return None


def defective_pairs(replies: DataFrame) -> DataFrame:
    """reply_id, defect: one row per defective pair.

    replies: reply_id, prompt, raw_response, replied_at; parse_error is not consulted. A null response is empty.
    Of rows with the same id the last replied counts, then the greater verdict. Whole texts are read. A null
    reply_id gives no row; an empty table gives an empty result; other columns are ignored.
    """
    rows = spread(replies.where("reply_id is not null").select(F.col("reply_id").cast("long").alias("reply_id"), "prompt", "raw_response", "replied_at"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda x: x if isinstance(x, str) else None
        for b in batches:
            found = [defect(text(p), text(r)) for p, r in zip(b["prompt"], b["raw_response"])]
            yield pd.DataFrame({"reply_id": b["reply_id"], "replied_at": b["replied_at"], "defect": pd.Series(found, dtype=object)})

    verdicts = rows.mapInPandas(judge, f"reply_id long, replied_at {rows.schema['replied_at'].dataType.simpleString()}, defect string")
    last = verdicts.groupBy("reply_id").agg(F.max_by(F.coalesce("defect", F.lit("")), F.struct("replied_at", F.coalesce("defect", F.lit("")))).alias("defect"))
    return last.where("defect <> ''")
