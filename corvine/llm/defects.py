"""Broken question and answer pairs, by noisy labelling functions under an EM label model.

Each sign of a defect has a few labelling functions that look at different evidence, vote or stay silent,
and may all be wrong: some are precise and rare, others fire on many sound answers. The votes of all
answers are counted by pattern (at most 2^m patterns of a sign, so the counts are tiny) and an
expectation-maximization label model with independent functions estimates from them how often each one
fires on defective and on sound answers; a function that fires on both alike loses its weight. The
posterior of a pattern is looked up for every answer. A label is retained above its sign's cutoff,
several if need be.

Labelled cases are made of every answer: blanked, cut off, marked as unfinished, replaced by their question
or by a refusal, or put under a question in another language. They anchor the model, so that EM separates
the defect and not something else. The cutoffs are validated crosswise: each half of the answers in turn is
judged by a model anchored on the cases of the other half, so every case is held out once. A case is
read for its own sign only and shares what was found in its answer.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.common import in_blocks, is_blank, plain_role
from corvine.scratch import cut

#: Defects in the order in which one of several retained labels is preferred.
DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
#: Signs of defects with the number of their labelling functions (see ``votes``) and the defect they tell.
SIGNS = {"empty": 3, "copy": 5, "refusal": 4, "stopped": 3, "opened": 3, "unfinished": 2, "language": 4}
TELLS = {s: "truncated" if s in ("stopped", "opened", "unfinished") else s for s in SIGNS}

# Common function words by language.
_STOP = {
    "en": "the of and to in is it that for with as was on are by this be at from or an not you have which but how does what why where who can when its into there their before after only between any if each every has had because until while my they them these without read first then both",
    "fr": "le la les des de du un une et est il que qui dans pour avec sur par ce cette ne pas plus au aux se son sa ses nous vous je elle ou mais comment pourquoi quand si sans chaque depuis d'où l'index été reste avait sont très fait entre leur ici avons hors car était y puis dont",
    "de": "der die das und ist in den von zu mit auf für nicht ein eine einen einem einer dem des im sich es als auch an wird aus er hat dass sie nach bei um am noch wie so über ich wir wenn ohne jeder jede was warum wer woher seit bis zur zum kann mir sein seine seinen seinem seiner bleibt bekommt",
    "es": "el la los las de del un una y es que en por con para se no al lo su sus como más pero este esta ese hay ya muy sin cada cuando qué cómo por qué quién dónde desde hasta entre porque puedo también está son sobre le nos mi ser fue",
}
_STOP = {k: frozenset(v.split()) for k, v in _STOP.items()}
_LETTERS = {"fr": "àâçèêëîïôùûœ", "de": "äöüß", "es": "ñ¿¡áíóú"}

# Phrases by which an answer declines; each line is one language.
_DECLINE = re.compile(
    "|".join(
        (
            r"\bi (?:can['’]?t|cannot|can not|am unable to|am not able to|won['’]?t be able to) (?:help|assist|answer|discuss|comply|do that|provide|share|describe)",
            r"\b(?:as an? (?:ai|assistant|language model)[^.]{0,40})?\bi(?: am|['’]m) not (?:allowed|permitted|able) to",
            r"\bi(?:['’]d| would) rather not|\bi (?:must|have to) (?:decline|refuse)|\bsomething i (?:have to|must) (?:decline|refuse)",
            r"\b(?:guidelines|rules|policy|policies) (?:keep|prevent|forbid|prohibit|don['’]t allow|do not allow)",
            r"\bno puedo (?:ayudar|responder|contestar|hablar)|\b(?:debo|tengo que) (?:rechazar|negarme)|\bprefiero no\b|\bno se me permite|\b(?:normas|reglas|pautas|directrices) (?:me |no )(?:impiden|prohíben|permiten|me permiten)|\bno me es posible|\bme es imposible",
            r"\bje ne (?:peux|puis) pas|\bje préfère ne pas|\bm['’]est impossible|\bconsignes m['’]|\bje (?:dois|suis obligée?) (?:de )?(?:refuser|décliner)|\bje refuse|\bje ne suis pas (?:autorisée?|en mesure)|\bdois décliner|\bdois refuser",
            r"\bkann ich (?:leider )?nicht (?:helfen|beantworten|weiterhelfen)|\bich kann (?:dabei|dazu|ihnen|hier|leider|das|diese)[^.]{0,40}nicht|\bmuss ich (?:leider )?ablehnen|\bkeine auskunft|\b(?:darf|möchte) ich (?:leider )?nicht|\bich (?:darf|möchte) (?:leider )?(?:[^.]{0,30} )?nicht|\brichtlinien (?:verbieten|untersagen|erlauben)|\bvorgaben (?:verbieten|untersagen|erlauben)|\blehne ich ab|\bist mir nicht (?:erlaubt|gestattet|möglich)",
            r"\bnon posso (?:aiutar|rispond)|\bpreferisco non|\bnon mi è (?:permesso|consentito)|\bnão posso (?:ajudar|responder)|\bprefiro não|\bik kan (?:u |je )?(?:daar|hier|dat)[^.]{0,30}niet",
        )
    ),
    re.I,
)
_REGRET = re.compile(
    r"\b(?:sorry|apologi[sz]e|apologies|unfortunately|regret|afraid|lo siento|lamento|lamentablemente|por desgracia|désolée?|malheureusement|regrette|leid|leider|bedau[e]?re|purtroppo|infelizmente|helaas)\b",
    re.I,
)
# The same for texts in lower case, which is much faster; not for letters that match others than their lower case.
_LOWER = {p: re.compile(p.pattern) for p in (_DECLINE, _REGRET)}
_ODD_CASE = re.compile("[İıſ]")
# First persons by language; verbs where the pronoun is usually left out.
_FIRST = frozenset("i me my mine we us our je j me m moi mon ma mes nous ich mir mich mein meine wir uns yo mi nos puedo prefiero debo tengo podemos".split())
# Endings of words that are common in one language and rare in the others.
_ENDINGS = {"en": ("ing", "ould", "ght", "tion", "ly", "ness"), "fr": ("eux", "aux", "eur", "ement", "ait", "ez", "ée", "oir"), "de": ("ung", "keit", "lich", "cht", "ieren", "tzt", "en", "st"), "es": ("ción", "dad", "ado", "ido", "ando", "iendo", "os", "as")}
# Plain refusals for made cases, by language of the question.
_REFUSALS = {
    "en": ("I'm sorry, but I can't assist with that.", "I have to decline this request.", "I am not able to answer that question.", "I cannot discuss this topic."),
    "fr": ("Je suis désolé, mais je ne peux pas répondre à cette question.", "Je dois refuser cette demande.", "Je préfère ne pas en parler."),
    "de": ("Es tut mir leid, dabei kann ich nicht helfen.", "Diese Anfrage muss ich ablehnen.", "Dazu darf ich nichts sagen."),
    "es": ("Lo siento, pero no puedo ayudar con eso.", "Debo rechazar esta solicitud.", "Prefiero no hablar de ese tema."),
}
# States and reasons of parts that mean the answer ended as it should.
_DONE_STATES = {"done", "output-available", "output-error", "output-denied", "complete", "completed", "result", "finished"}
_DONE_REASONS = {"stop", "end_turn", "end-turn", "stop_sequence", "stop-sequence", "eos", "tool-calls", "tool_calls", "tool_use", "complete", "completed", "done", "finished"}

_FENCE = re.compile(r"^[ \t]*(?:>[ \t]*)?(```+|~~~+)", re.M)
_WORD = re.compile(r"[^\W_]+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_QUOTED = re.compile(r"\"[^\"\n]{0,400}\"|“[^”\n]{0,400}”|„[^“\n]{0,400}“|«[^»\n]{0,400}»")
_NAMES = re.compile(r"(?<!\S)[^\s/_\d]*+[/_\d]\S*|\b\w*[a-z][A-Z]\w*")
_SPOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SPECIAL = re.compile(f"[{''.join(_LETTERS.values())}]")
#: Words after which a sentence cannot end, of any of the languages.
_DANGLING = frozenset("the a an of and or to in with because which that for from le la les un une des du de et ou dans avec parce que qui pour der die das und oder mit weil dass für el los las una y o en con porque para del".split())
_BEGIN = re.compile(r"(?<=\s)\S")
_PLACE = re.compile(r"\w/\w[\w./-]*\.\w{1,6}\b|`")
_REF = re.compile(r"[\w./-]*\w\.\w{1,6}(?::\d+(?:-\d+)?)?$")


def _parts(parts: str | list[dict] | None) -> list[dict]:
    """The parts; none if they are null, [] or no JSON, which says nothing. Parts read before are taken as they are."""
    if isinstance(parts, list):
        return parts
    try:
        rows = json.loads(parts) if parts else []
    except ValueError:
        return []
    return [x for x in rows if isinstance(x, dict)] if isinstance(rows, list) else []


def unfinished(rows: list[dict]) -> tuple[bool, bool]:
    """(a part's state, reason or type tells of another end than a stop, no part tells of a stop); rows are the parts."""
    broken = ended = False
    for part in rows:
        data = part.get("data") if isinstance(part.get("data"), dict) else {}
        marks = [(part.get("state"), _DONE_STATES), *((place.get(name), _DONE_REASONS) for place in (part, data) for name in ("reason", "finishReason", "finish_reason"))]
        for mark, fine in marks:
            if isinstance(mark, str):
                broken |= mark not in fine
                ended |= mark in fine
        broken |= str(part.get("type")) in ("abort", "data-abort", "error", "data-error")
    return broken, bool(rows) and not ended


def _outside_fences(text: str) -> tuple[str, bool, str]:
    """(text without fenced blocks, True if a block is left open, the last block)."""
    out, at, opened, block = [], 0, None, ""
    for m in _FENCE.finditer(text):
        if opened is None:
            out.append(text[at : m.start()])
            opened, at = m.group(1), m.end()
        elif m.group(1).startswith(opened):
            block = text[at : m.start()]
            line_end = text.find("\n", m.end())
            at, opened = (len(text) if line_end < 0 else line_end), None
    if opened is None:
        out.append(text[at:])
    else:
        block = text[at:]
    return "\n".join(out), opened is not None, block


def _trimmed(text: str) -> str:
    end = len(text)
    while end and is_blank(text[end - 1]):
        end -= 1
    return text[:end]


def _no_ending(text: str) -> bool:
    """True if the last line is neither a sentence, a list entry, a reference, a table row nor code."""
    text = _trimmed(text)
    if not text or text.endswith(("```", "~~~")):
        return False
    lines = text.split("\n")
    last = lines[-1].strip()
    core = last.rstrip("\"'”’»›*_)]}`")
    if core.endswith((".", "!", "?", "…", "。", "？", "！")):
        return last.count("(") > last.count(")")
    if last.endswith(("`", ")", "]", "|", '"', "”", "»", "“")):
        return last.count("(") > last.count(")") or last.endswith(")") and "(" not in last
    if last.startswith("#") or _REF.search(last.rsplit(None, 1)[-1]):
        return False
    if _ITEM.match(last):
        items = [x.strip() for x in lines[:-1] if _ITEM.match(x)]
        return not items or any(x.endswith((".", "!", "?", "`")) for x in items)
    return True


def _prose(text: str, plain: str | None = None) -> str:
    """The text without code, quotations, names and numbers; ``plain`` is the text outside fences if known."""
    text = _outside_fences(text)[0] if plain is None else plain
    if "`" in text:
        text = re.sub(r"`[^`\n]*`?", " ", text)
    return _NAMES.sub(" ", _QUOTED.sub(" ", text))


def _best(counts: dict[str, int], least: int) -> str | None:
    first, second = sorted(counts.values(), reverse=True)[:2]
    return max(counts, key=counts.get) if first > second and first >= least else None


@lru_cache(maxsize=100_000)
def _told_by(word: str) -> int:
    """Bits of the languages of which a word is a function word and, above them, of those in which words end like it."""
    return sum((word in v) << j for j, v in enumerate(_STOP.values())) | sum(word.endswith(_ENDINGS[k]) << j for j, k in enumerate(_STOP, len(_STOP)))


def _languages(text: str) -> tuple[str | None, str | None, str | None, dict[str, int]]:
    """Main language by function words, by letters and by endings of words; the counts of function words."""
    low = text.lower()
    by_word, by_ending, by_letter = (dict.fromkeys(_STOP, 0) for _ in range(3))
    for told, n in Counter(map(_told_by, _SPOKEN.findall(low))).items():
        for j, k in enumerate(_STOP):
            by_word[k] += n * (told >> j & 1)
            by_ending[k] += n * (told >> j + len(_STOP) & 1)
    for c in _SPECIAL.findall(low):
        for k, v in _LETTERS.items():
            by_letter[k] += c in v
    total = sum(by_word.values())
    word = _best(by_word, 2 if total > max(by_word.values()) else 1)
    letter = _best(by_letter, 1)
    if letter and word and letter != word and by_word[letter] >= by_word[word] / 2:
        word = letter
    return word, letter, _best(by_ending, 2), by_word


def _sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n+", text) if _WORD.search(x)]


def _found(pattern: re.Pattern, text: str) -> bool:
    """True if a pattern of ``_LOWER`` is found in whatever case."""
    return bool(pattern.search(text) if _ODD_CASE.search(text) else _LOWER[pattern].search(text.lower()))


def _declines(question: str, sentences: list[str]) -> bool:
    """True if a sentence declines and not more than four times as many say something else than the question."""
    asked = set(_WORD.findall(question.lower()))
    declined = other = 0
    for sentence in sentences:
        words = _WORD.findall(sentence.lower())
        if _found(_DECLINE, sentence):
            declined += 1
        elif not _found(_REGRET, sentence) and sum(w in asked for w in words) < 0.8 * len(words):
            other += 1
    return declined > 0 and other <= 4 * declined


class Text(str):
    """A text that keeps what is found in it, for its own votes and those of its cases."""

    @cached_property
    def blank(self) -> bool:
        return is_blank(self)

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.lower())

    @cached_property
    def outside(self) -> tuple[str, bool, str]:
        return _outside_fences(self)

    @cached_property
    def prose(self) -> str:
        return _prose(self, self.outside[0])

    @cached_property
    def tongue(self) -> tuple[str | None, str | None, str | None, dict[str, int]]:
        return _languages(self.prose)

    @cached_property
    def said(self) -> list[str]:
        return _sentences(_QUOTED.sub(" ", re.sub(r"`[^`\n]*`", " ", self.outside[0])))

    @cached_property
    def tone(self) -> tuple[bool, int]:
        """(a phrase declines and nothing is listed, the votes of ``_refusal`` that need no question)."""
        plain = self.outside[0]
        listed = "```" in self or "~~~" in self or any(_ITEM.match(x) for x in plain.split("\n"))
        spoken = sum(not _FIRST.isdisjoint(_WORD.findall(x.lower())) for x in self.said)
        mask = 2 * any(_found(_REGRET, x) for x in self.said) | 4 * (len(self.words) <= 45 and not listed and not _PLACE.search(self)) | 8 * (bool(self.said) and 2 * spoken >= len(self.said))
        return not listed and _found(_DECLINE, plain), mask


_REFUSED = {k: tuple(map(Text, v)) for k, v in _REFUSALS.items()}


def _text(text: str | None, tongue: tuple | None = None) -> Text:
    out = text if isinstance(text, Text) else Text(text or "")
    if tongue is not None:
        out.tongue = tongue
    return out


def _empty(q: Text, a: Text, rows: list[dict]) -> int:
    texts = [str(x["text"]) for x in rows if "text" in x]
    return 1 * a.blank | 2 * (len(a.words) < 3) | 4 * (bool(texts) and not any(_WORD.search(t) for t in texts))


def _copy(q: Text, a: Text, rows: list[dict]) -> int:
    qw, aw = q.words, a.words
    if not qw or not aw:
        return 0
    pool = Counter(aw)
    asked = [(n, pool[w]) for w, n in Counter(qw).items() if w in pool]
    shared, new = sum(map(min, asked)), len(aw) - sum(n for _, n in asked)
    return (
        1 * (shared >= 0.95 * len(qw) and len(aw) - shared <= max(6, len(qw) // 4))
        | 2 * (f" {' '.join(qw)} " in f" {' '.join(aw)} ")
        | 4 * (aw[-4:] == qw[-4:])
        | 8 * (0.8 * len(qw) <= len(aw) <= 1.4 * len(qw) + 6)
        | 16 * (new <= 0.25 * len(aw))
    )


def _refusal(q: Text, a: Text, rows: list[dict]) -> int:
    may, mask = a.tone
    return mask | 1 * (may and _declines(q, a.said))


def _opened(q: Text, a: Text, rows: list[dict]) -> int:
    plain, open_fence, block = a.outside
    return open_fence | 2 * (plain.count("`") % 2 == 1) | 4 * any(block.count(x) > block.count(y) for x, y in ("()", "[]", "{}"))


def _stopped(q: Text, a: Text, rows: list[dict]) -> int:
    end = _trimmed(a)
    if a.outside[1] or end.endswith(("```", "~~~")):
        return 0
    tail = _WORD.findall(end[-80:].lower())
    return (
        1 * _no_ending(a)
        | 2 * (bool(tail) and tail[-1] in _DANGLING or end.endswith((",", "(", "-", "/", "[", "{", "=")))
        | 4 * (not any(c in ".!?:…。？！)`|]}" for c in end[-2:]))
    )


def _unfinished(q: Text, a: Text, rows: list[dict]) -> int:
    broken, no_stop = unfinished(rows)
    return broken | 2 * no_stop


def _language(q: Text, a: Text, rows: list[dict]) -> int:
    (ql, qletter, qend, _), (al, aletter, aend, counts) = q.tongue, a.tongue
    asked = ql or qletter
    return (
        1 * bool(asked and al and asked != al)
        | 2 * bool(aletter and asked and aletter != asked)
        | 4 * bool(aend and (ql or qend) and aend != (ql or qend))
        | 8 * bool(ql and sum(counts.values()) and not counts[ql])
    )


_VOTES = {"empty": _empty, "copy": _copy, "refusal": _refusal, "stopped": _stopped, "opened": _opened, "unfinished": _unfinished, "language": _language}


def vote(sign: str, question: str | None, answer: str | None, parts: str | list[dict] | None) -> int:
    """The entry of ``votes`` for one sign, without the work for the others."""
    a = _text(answer)
    return 0 if sign != "empty" and a.blank else int(_VOTES[sign](_text(question), a, _parts(parts)))


def votes(question: str | None, answer: str | None, parts: str | list[dict] | None) -> dict[str, int]:
    """Bit masks of the labelling functions that fire, by sign, from the lowest bit.

    empty: nothing visible; fewer than three words; the parts have texts, none with a word.
    copy: the question's words make up nearly all; the question stands in it as one run; it ends with the
    question's last words; it is about as long; hardly a word is new.
    refusal: a sentence declines and little else is said; it regrets; it is brief, without code, list
    or place in a file; half of its sentences or more speak in the first person.
    stopped: the last line has no ending; the last word calls for another one; no mark stands at the end.
    opened: a code block is open; an inline mark of code is open; brackets of the last block are open.
    unfinished: a part's state, reason or type says so; none tells of a stop.
    language: function words, special letters, or endings of words tell another language than the
    question's; none of its function words occurs.
    """
    q, a, rows = _text(question), _text(answer), _parts(parts)
    return {s: 0 if s != "empty" and a.blank else int(f(q, a, rows)) for s, f in _VOTES.items()}


def _cut_off(i: int, text: str, lo: int, hi: int) -> str | None:
    """``text`` cut before one of the last words that begin between lo and hi, where no sentence ends."""
    width, places = 128, []
    while len(places) < 6:  # sought from the end, as only the last words matter
        at = max(lo + 1, hi - width)
        places, width = [m.start() for m in _BEGIN.finditer(text, at, hi)], 8 * width
        if at == lo + 1:
            break
    if len(places) < 6:
        return None
    head = text[: places[-1 - i % 5]].rstrip()
    return None if head[-1:] in ".!?:`)]|\"”»>*}" else head


def _cases(i: int, q: Text, a: Text, parts: list[dict], lent: Text | None) -> Iterator[tuple[str, tuple]]:
    """(sign, (question, answer, parts)): defective versions of a pair; ``i`` varies them."""
    if q.blank or a.blank:
        return
    yield "empty", (q, ("", None, " \u200b\n", "\n\n")[i % 4], ([], [{"type": "text", "text": ""}])[i % 8 > 5])
    yield "copy", (q, (q, f"> {q}", f'"{q}"', f"You ask: {q}")[i % 4], [])
    spoken = q.tongue[0]
    if spoken in _REFUSED:
        said = _REFUSED[spoken]
        yield "refusal", (q, said[i % len(said)], [])
    fences = [m.start() for m in _FENCE.finditer(a)]
    if len(fences) % 2 == 0 and (head := _cut_off(i, a, a.rfind("\n") + 1 if fences else 0, len(a))):
        yield "stopped", (q, head, [])
    if len(fences) > 1 and (head := _cut_off(i, a, fences[-2] + 8, fences[-1])):
        yield "opened", (q, head, [])
    mark = ({"type": "text", "text": a, "state": "streaming"}, {"type": "finish", "finishReason": "length"})[i % 2]
    yield "unfinished", (q, a, [*parts, mark])
    if lent is not None and len(_WORD.findall(a.prose)) >= 8:
        yield "language", (lent, a, [])


def _lenders(spoken: list[str | None]) -> list[int | None]:
    """For each place the next one, round the end, where another language is spoken."""
    n, nearest, out = len(spoken), {}, [None] * len(spoken)
    for j in range(2 * n - 1, -1, -1):
        if known := spoken[j % n]:
            if j < n:
                at = min((x for k, x in nearest.items() if k != known), default=None)
                out[j] = at if at is None else at % n
            nearest[known] = j
    return out


def _read(pairs: list[tuple[str | None, str | None, str | None]]) -> Iterator[tuple[Text, Text, list[dict], Text | None]]:
    """(question, answer, parts, a question in another language that is lent) of the pairs, one by one.

    The next pair in another language lends its question; both languages are told by their questions, not
    by the answers. Only what is told of the questions' languages is kept for all pairs.
    """
    tongues = [_languages(_prose(q or "")) for q, _, _ in pairs]
    lenders = _lenders([t[0] for t in tongues])
    for (q, a, parts), tongue, j in zip(pairs, tongues, lenders):
        yield _text(q, tongue), _text(a), _parts(parts), None if j is None else _text(pairs[j][0], tongues[j])


def made_cases(pairs: list[tuple[str | None, str | None, str | None]]) -> Iterator[tuple[int, str, tuple]]:
    """(index, sign, (question, answer, parts)): defective versions of the pairs, each sign once where it can be made."""
    for i, read in enumerate(_read(pairs)):
        for sign, case in _cases(i, *read):
            yield i, sign, case


def _vote_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Votes of every answer; then, with a sign and no message_id, counts of votes on the answers and on cases made of each."""
    for pdf in batches:
        found: list[dict[str, int]] = []
        counts: Counter = Counter()
        halves = pdf["half"].tolist()
        for i, read in enumerate(_read(list(zip(pdf["question"], pdf["answer"], pdf["parts"])))):
            found.append(votes(*read[:3]))
            counts.update((halves[i], False, s, p) for s, p in found[-1].items())
            counts.update((halves[i], True, s, vote(s, *case)) for s, case in _cases(i, *read))
        out = pd.DataFrame(found, columns=list(SIGNS), dtype="int32")
        out.insert(0, "message_id", pdf["message_id"].to_numpy())
        yield out.assign(half=0, made=False, sign=None, pattern=0, n=0)
        half, made, sign, pattern, n = zip(*((*k, c) for k, c in counts.items())) if counts else ((),) * 5
        yield pd.DataFrame({"message_id": None, **dict.fromkeys(SIGNS, 0), "half": half, "made": made, "sign": sign, "pattern": pattern, "n": n})


class LabelModel:
    """Independent functions under a hidden defect, fitted by EM to counts of vote patterns.

    The rates at which functions fire on defective answers begin at those of the labelled cases, which
    count as much as ``ANCHOR`` answers; the rates on sound answers begin at half of the rates on all, with
    as many silent answers; the share of defective answers begins at 3 %.
    From there all rates are free, also that of silence and of functions that fire more often on sound answers.
    """

    ANCHOR = 50.0

    def __init__(self, n_functions: int, counts: dict[int, int], cases: dict[int, int] | None = None, rounds: int = 200) -> None:
        m, total, n = n_functions, sum(counts.values()), sum((cases or {}).values())
        fired = lambda table, j: sum(c for p, c in table.items() if p >> j & 1)
        known = [(fired(cases, j) + 0.5) / (n + 1) if n else 0.6 for j in range(m)]
        self.m, self.prior = m, 0.03
        self.hit, self.noise = list(known), [(fired(counts, j) / 2 + 0.05) / (total + self.ANCHOR) for j in range(m)]
        for _ in range(rounds):
            weight = {p: self.posterior(p) * c for p, c in counts.items()}
            bad = sum(weight.values())
            before = [self.prior, *self.hit, *self.noise]
            self.prior = min(0.5, (bad + 0.03 * self.ANCHOR) / (total + self.ANCHOR))
            for j in range(m):
                on = fired(weight, j)
                self.hit[j] = (on + self.ANCHOR * known[j]) / (bad + self.ANCHOR)
                self.noise[j] = (fired(counts, j) - on + 0.05) / (total - bad + self.ANCHOR)
            if max(abs(x - y) for x, y in zip(before, [self.prior, *self.hit, *self.noise])) < 1e-9:
                break

    def posterior(self, pattern: int) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for j in range(self.m):
            h, z = (min(1 - 1e-6, max(1e-6, x)) for x in (self.hit[j], self.noise[j]))
            odds += math.log(h / z) if pattern >> j & 1 else math.log((1 - h) / (1 - z))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))

    def cutoff(self, cases: dict[int, int], others: dict[int, int]) -> float:
        """``best_cutoff`` of this model alone, on cases that it was not anchored on."""
        return best_cutoff(map(self.posterior, {*cases, *others}), [(self, cases, others)])


def best_cutoff(posteriors: Iterable[float], judged: list[tuple[LabelModel, dict[int, int], dict[int, int]]]) -> float:
    """The cutoff between 0.05 and 0.95 with the best F1 over labelled cases; of equal ones that next to 0.5.

    It is one between ``posteriors``. ``judged`` has models, each with cases that it was not anchored on: the
    patterns of defective cases, which count as often as the defect is expected, and those of the
    answers they were made of, less what the model takes for defective.
    """
    right, wrong, total = [], [], 0.0
    for model, cases, others in judged:
        n, sound = sum(cases.values()), {p: c * (1 - model.posterior(p)) for p, c in others.items()}
        if not n or not sum(sound.values()):
            continue
        each = max(1e-9, model.prior * sum(others.values()) / n)
        right += [(model.posterior(p), each * x) for p, x in cases.items()]
        wrong += [(model.posterior(p), x) for p, x in sound.items()]
        total += each * n
    steps = sorted({0.05, 0.95, *(min(0.95, max(0.05, p)) for p in posteriors)})
    best, at = -1.0, 0.5
    for c in sorted(((lo + hi) / 2 for lo, hi in zip(steps, steps[1:])), key=lambda c: abs(c - 0.5)) if right else ():
        kept, extra = (sum(x for p, x in rows if p >= c) for rows in (right, wrong))
        f1 = 2 * kept / (kept + extra + total)
        if f1 > best + 1e-6:
            best, at = f1, c
    return at


def answer_pairs(messages: DataFrame) -> DataFrame:
    """(message_id, question, answer, parts): assistant rows that directly follow a user row.

    Rows are those of a conversation with a time, ordered by it (at equal times the user first, then
    the smaller id); blank ones stay. Rows with equal id count once. Further columns are ignored.
    """
    rows = messages.select("id", "conversation_id", plain_role(F.col("role")).alias("role"), "content", "parts", "created_at")
    rows = rows.filter("id is not null and conversation_id is not null and created_at is not null").dropDuplicates(["id"])
    rows = cut(rows, "messages").withColumn("side", F.when(F.col("role") == "user", 0).otherwise(1))
    laid = in_blocks(rows, "conversation_id", ["created_at", "side", "id"], 1)
    order = Window.partitionBy("conversation_id", "_block").orderBy("created_at", "side", "id")
    laid = laid.withColumns({"before": F.lag("role").over(order), "question": F.lag("content").over(order)})
    return laid.filter(~F.col("_context") & (F.col("role") == "assistant") & (F.col("before") == "user")).select(
        F.col("id").alias("message_id"), "question", F.col("content").alias("answer"), "parts"
    )


def label_model(sign: str, counts: Counter) -> tuple[LabelModel, float]:
    """(model, cutoff) of a sign from ``counts`` by (half, made, sign, pattern) of the votes on all answers and cases.

    The model is anchored on the cases of all answers. Its cutoff is validated with two others, each anchored
    on one half's cases and judging those of the other half.
    """
    def table(made: bool, *halves: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for (half, is_made, s, pattern), n in counts.items():
            if s == sign and is_made == made and half in halves:
                out[pattern] = out.get(pattern, 0) + n
        return out

    every, m = table(False, 0, 1), SIGNS[sign]
    model = LabelModel(m, every, table(True, 0, 1))
    judged = [(LabelModel(m, every, table(True, 1 - h)), table(True, h), table(False, h)) for h in (0, 1)]
    return model, best_cutoff(map(model.posterior, {*every, *table(True, 0, 1)}), judged)


def labels(messages: DataFrame) -> DataFrame:
    """(message_id, defect, posterior): every retained label of every answer.

    Null content is an empty answer; a null question has no copy or language label. An empty table
    gives an empty result. Labelled cases, votes, counts and labels cover all answers.
    """
    pairs = answer_pairs(messages).withColumn("half", F.pmod(F.xxhash64("message_id"), F.lit(2)).cast("int"))
    voting = pairs.mapInPandas(
        _vote_batches, "message_id string, " + ", ".join(f"{s} int" for s in SIGNS) + ", half int, made boolean, sign string, pattern int, n bigint"
    )
    voted = cut(voting, "votes")
    # at most 2^m rows a sign and half, made or not
    summed = voted.filter("message_id is null").groupBy("half", "made", "sign", "pattern").agg(F.sum("n").alias("n")).collect()
    counted = Counter({(r["half"], r["made"], r["sign"], r["pattern"]): r["n"] for r in summed})
    one = []
    for s in SIGNS:
        model, least = label_model(s, counted)
        every = {p for _, made, sign, p in counted if sign == s and not made}
        kept = {p: model.posterior(p) for p in every if p and model.posterior(p) >= least}
        if kept:
            known = F.create_map(*[F.lit(x) for kv in sorted(kept.items()) for x in kv])
            one.append(F.struct(F.lit(TELLS[s]).alias("defect"), F.element_at(known, F.col(s)).alias("posterior")))
    if not one:
        return voted.select("message_id", F.lit("").alias("defect"), F.lit(0.0).alias("posterior")).limit(0)
    # the signs of an answer stand in one row, so the best of several that tell one defect needs no shuffle
    found = F.filter(F.array(*one), lambda x: x["posterior"].isNotNull())
    best = lambda d: F.array_max(F.filter("found", lambda x: x["defect"] == d))
    ranked = [best(d) for d in DEFECTS]
    rows = voted.filter("message_id is not null").withColumn("found", found).filter(F.size("found") > 0)
    rows = rows.select("message_id", F.explode(F.filter(F.array(*ranked), lambda x: x.isNotNull())).alias("x"))
    return rows.select("message_id", "x.defect", "x.posterior")


def one_label(messages: DataFrame) -> DataFrame:
    """(message_id, defect): of several retained labels the first in the order of ``DEFECTS``."""
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return labels(messages).groupBy("message_id").agg(F.min_by("defect", rank).alias("defect"))
