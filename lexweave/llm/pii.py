"""Personal information in free text: a skip-chain conditional random field.

Labels are O and, for email, phone, id_number, address and name, the first and
the following tokens of an item.  A token's potential comes from its word,
shape, prefixes and suffixes, those of its neighbours, whether it is or is
built like a known name, and, where it lies in a span that has the form of an
email, phone number, identity number, address or name, from that span: its
shape and the words around it.  Forms propose, the field decides: no rule
speaks at labelling time, and an item needs no form.  Tokens of a sentence are
linked in a chain.  Repeated and similar tokens of a document that could be
names are linked as well, over any distance (the skip chain): equal words but
for a possessive, words a letter apart, and an initial with a given name.  The
links of a group form a tree of small depth, and message passing goes on until
the beliefs settle, so what one place says reaches all others.  Sentences in which no form, title, word
of kinship or link occurs have no items.  An exact check
of the bounds follows: an item is set to the bounds of the span it overlaps.

Training.  There are no rated texts, so the field is trained on at most
``TRAINING_DOCS`` documents, taken by a hash of the id, that are labelled by
strict rules (a form together with a telling context), and on a few generic
sentences filled with known names.  What the rules can't tell stays open, and
the likelihood sums over all labels there.  In some of the sentences the field
doesn't see the forms, so words, shapes and neighbours are learnt as well.  Skip
potentials are estimated from the labels of linked tokens.  All texts are then
labelled whole.

Defined results: null and blank texts have no items and stay as they are; an
item's value is as it stands in the text; null ids are kept; empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .share import share
from .common import table, whole_list

TRAINING_DOCS = 2_000
#: Shares of training sentences in which the field doesn't see the forms, and in which it sees next neighbours only.
FORMS_HIDDEN, CONTEXT_HIDDEN = 0.15, 0.3
KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
#: Kind of each label, 0 for O: what is said of a span holds for its first token and those that follow.
KIND_OF = (np.arange(N) + 1) // 2
#: Rounds of messages over skip links at most; they end when no message moves by more than ``SETTLED``.
MOST_ROUNDS, SETTLED = 20, 0.02
#: Features of the spans over a token at most: three kinds may overlap.
SPAN_WIDTH = 54
REACH = (-3, -2, -1, 0, 1, 2)

# Words of the labelling rules that tell what follows or precedes.
TITLES = set("dr mr mrs ms miss prof professor doctor nurse sir frau herr herrn sra sr srta dra don doña señor señora".split())
KIN = set(
    "mother father son daughter brother sister husband wife partner caregiver carer neighbour neighbor aunt uncle cousin friend "
    "guardian mutter vater sohn tochter bruder schwester ehemann ehefrau angehörige angehöriger hija hijo madre padre hermano hermana "
    "esposa esposo marido mujer".split()
)
NAMED_THINGS = set(
    "score scale sign test catheter index criteria criterion syndrome disease reflex manoeuvre maneuver line tube drain stent forceps "
    "needle procedure method grade stage class classification triad phenomenon position splint collar clinic ward unit wing street".split()
)
UNITS = set("mg ml mcg g kg units hours days mmhg cm mm percent".split())
PERSON_ID = re.compile(
    r"(?:\bmrn|\bssn|\bss\s?#|\bsocial(?:\s+security)?|\bsoc\.?\s+sec|\bpassport|\blicen[cs]e|\bmember\s+id|\bpolicy|\binsurance|\bchart|"
    r"\brecord|\bunit\s+number|\bhosp|\bmed\.?\s+rec|\bnhs|versichertennummer|ausweis\w*|historia|\bdni|\bpatient\s+id)"
    r"[\s.:#]*(?:holder\s+)?(?:(?:no|number|num|nr|id)\b)?[\s.:#]*$",
    re.I,
)
THING_ID = re.compile(r"(?:order|specimen|sample|lot|batch|device|serial|ext|extension)[\s.:#]*(?:no|number)?[\s.:#]*$", re.I)
PHONE_CUE = re.compile(r"(?:\btel\w*|\bcb\b|phone\w*|call\w*|fax|mobile|cell|contact\w*|ring|rang|reach\w*|teléfono|móvil|mobil|anruf\w*)\W+(?:\w+\W+){0,3}$", re.I)

STREET = (
    "street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|court|ct|close|way|terrace|place|pl|square|sq|crescent|parkway|pkwy|highway|circle|row|walk"
)
_L = r"[^\W\d_]"
FORMS = {
    "email": re.compile(
        r"(?<![\w.+-])[\w][\w.+-]*(?:\s?@\s?|\s?\[at\]\s?)[a-z0-9-]+(?:\.[a-z0-9-]+)+"
        r"|(?<![\w.+-])[\w][\w.+-]*\s+at\s+[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+",
        re.I,
    ),
    "phone": re.compile(
        r"(?<![\w+/#-])(?:"
        r"\+\d{1,3}[\s.-]?\(0\)\s?\d{2,5}[\s.-]\d{3}[\s.-]?\d{3,4}"
        r"|(?:\+?1[\s.-])?\(\d{3}\)\s?\d{3}[\s.-]\d{4}"
        r"|(?:\+?1[\s.-])?\d{3}\s-\s\d{3}\s-\s\d{4}"
        r"|(?:\+?1[\s.-])?\d{3}[\s./-]\d{3}[\s.-]\d{4}"
        r"|\+\d{1,3}[\s.-]\d{2,5}[\s.-]\d{3}[\s.-]?\d{3,4}"
        r"|0\d{2,4}[\s-]\d{6,7}"
        r"|\d{10}"
        r"|\d{3}-\d{4}"
        r")(?![\w-])"
    ),
    "id_number": re.compile(r"(?<![\w+/-])(?:[A-Z]{1,3}-?)?\d{2,}(?:[ -]\d{2,}|\n\d{2,})*(?![\w/:]|-\w|\.\d)"),
    "address": re.compile(
        rf"(?<![\w-])\d{{1,5}}\s?[A-Za-z]?\s+(?:[NSEW]\.?\s+)?(?:{_L}+\s+){{1,3}}(?:{STREET})\b(?:\.?,?\s+(?:apt|unit|suite|ste|flat)\.?\s*\w+|\.?\s*\#\s?\w+)?",
        re.I,
    ),
}
N_FLAGS = 2 * len(KINDS) + 8
#: More forms of addresses, with what a lower-cased text must hold for each to be looked for.
MORE_ADDRESSES = (
    (("box",), re.compile(r"\bP\.?\s?O\.?\s?Box\s+\d+", re.I)),
    (
        ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee"),
        re.compile(r"\b[A-ZÄÖÜ][A-Za-zäöüßÄÖÜ]*(?:straße|strasse|str\.|weg|gasse|platz|allee)\s+\d+\s?[a-z]?\b", re.I),
    ),
    (
        ("calle", "c/", "avenida", "avda.", "paseo", "plaza", "camino"),
        re.compile(rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.|Paseo|Plaza|Camino)\s+(?:{_L}+\s+){{0,3}}{_L}+,?\s+\d+[a-z]?\b", re.I),
    ),
)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]|_")
_ABBREVIATED = set("ave blvd apt hosp med rec soc sec ste str".split())

#: Generic sentences for a start; {n} name, {e} email, {p} phone, {i} identity number, {a} address.
SENTENCES = (
    "Please call {n} at {p} today.", "The patient's mother {n} was present.", "Seen by Dr. {f} this morning.", "MRN {i}", "SSN: {i}",
    "Send the letter to {e} please.", "She lives at {a} with her son.", "Contact: {n}, {a}, tel {p}", "Signed: {n}", "Mr {f} called from {p}.",
    "Passport no. {i} was shown.", "The {f} score was 8.", "A {f} catheter was placed.", "The {f} sign was negative.", "Frau {f} wohnt {a}.",
    "La Sra. {f} vive en {a}.", "Name: {n}   policy holder id: {i}", "{n} was told about the plan.", "Next of kin is {n} (<{e}>).",
    "The office is at {a}.", "Mail it to {a}.", "Order {i} was cancelled.", "Lot {i} was used.", "Specimen {i} was sent.", "Device no. {i} was read.",
    "Social security no. {i} is on file.", "social {i}", "Chart {i}", "Medical record no. {i}", "NHS number {i}", "Licence no. {i}", "Insurance {i}", "DNI {i}", "Versichertennummer {i}",
)


class Names:
    """Known names, and what they are built of: heads and tails found in three names or more."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family
        self.built = {"given": self._parts(given), "family": self._parts(family)}

    @staticmethod
    def _parts(names: set[str]) -> tuple[set[str], set[str]]:
        heads, tails = Counter(), Counter()
        for w in names:
            for k in range(2, len(w) - 1):
                heads[w[:k]] += 1
                tails[w[k:]] += 1
        return {h for h, n in heads.items() if n >= 3}, {t for t, n in tails.items() if n >= 3 and len(t) >= 2}

    def is_a(self, low: str, kind: str) -> bool:
        if low in (self.given if kind == "given" else self.family):
            return True
        heads, tails = self.built[kind]
        return len(low) >= 5 and any(low[:k] in heads and low[k:] in tails for k in range(2, len(low) - 1))


class Doc:
    """Tokens of a text with the spans that have the form of an item."""

    no_names = TITLES | KIN | NAMED_THINGS | set("the a an this name contact by attn with and from to of at signed dictated der die das el la los".split())

    def __init__(self, text: str, names: Names, cache: dict) -> None:
        self.text = text
        m = list(_TOKEN.finditer(text))
        self.start = np.array([x.start() for x in m], np.int64)
        self.end = np.array([x.end() for x in m], np.int64)
        self.words = [x.group() for x in m]
        self.spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        low = text.lower()
        has_digit = re.search(r"\d", text) is not None
        for kind, form in FORMS.items():
            if kind != "email" and not has_digit or kind == "email" and "@" not in low and "dot" not in low and "[at]" not in low:
                continue
            met = [x.span() for x in form.finditer(text)]
            if kind == "address":
                more = [x.span() for needs, f in MORE_ADDRESSES if any(n in low for n in needs) for x in f.finditer(text)]
                # Where two forms meet, the one that starts first holds, then the longer.
                held, last = [], -1
                for a, b in sorted(met + more, key=lambda x: (x[0], -x[1])):
                    if a >= last:
                        held.append((a, b))
                        last = b
                met = held
            for a, b in met:
                if kind == "id_number" and sum(c.isdigit() for c in text[a:b]) < 6:
                    continue
                i, j = int(np.searchsorted(self.start, a)), int(np.searchsorted(self.end, b, "right"))
                if i < j and self.start[i] == a:
                    self.spans[kind].append((i, j))
        kind_of = []
        for w in self.words:
            c = cache.get(w)
            if c is None:
                low = w.lower()
                c = cache[w] = (
                    (1 if names.is_a(low, "given") else 0) | (2 if names.is_a(low, "family") else 0) | (4 if low in TITLES or low in KIN else 0)
                    if w[0].isalpha()
                    else 4 * (w == "@")
                )
            kind_of.append(c)
        kinds = np.array(kind_of, np.int64)
        self.cues = np.flatnonzero(kinds & 4)
        self.name_kind = (kinds & 3).tolist()
        if (kinds & 3).any():
            self._name_spans()

    def _initial(self, i: int) -> bool:
        return i + 1 < len(self.words) and len(self.words[i]) == 1 and self.words[i].isupper() and self.words[i + 1] == "."

    def _name_spans(self) -> None:
        """Given [I.] family[-family], family[-family], given [I.], I. family[-family], or a lone family name."""
        w, k, n = self.words, self.name_kind, len(self.words)
        i = 0

        def family(j: int) -> int:
            if j < n and k[j] & 2:
                j += 1
                if j + 1 < n and w[j] == "-" and k[j + 1] & 2 and self.start[j] == self.end[j - 1]:
                    j += 2
                return j
            return -1

        def given(j: int) -> bool:
            """A given name, or a capitalised word that no list knows and that isn't the first of a sentence's title."""
            if j >= n or not w[j][0].isalpha():
                return False
            return bool(k[j] & 1) or (w[j][0].isupper() and len(w[j]) > 2 and w[j].lower() not in self.no_names)

        while i < n:
            if k[i] or self._initial(i) or (given(i) and i + 1 < n and (k[i + 1] & 2 or self._initial(i + 1))):
                end = -1
                if self._initial(i):
                    end = family(i + 2)
                if end < 0 and k[i] & 2:
                    f = family(i)
                    if f > 0 and f + 1 < n and w[f] == "," and given(f + 1) and not (f + 2 < n and k[f + 2] & 2):
                        end = f + 2
                        if self._initial(end):
                            end += 2
                if end < 0 and given(i):
                    j = i + 1
                    if self._initial(j):
                        j += 2
                    end = family(j)
                if end < 0 and k[i] & 2:
                    end = family(i)
                if end > 0:
                    self.spans["name"].append((i, end))
                    i = end
                    continue
            i += 1

    def pieces(self) -> list[tuple[int, int]]:
        """Sentences, as token ranges; the chain is cut between them.

        Longer ones end at a line break or between two lower-case words that no
        form covers, never inside an item.
        """
        w, n = self.words, len(self.words)
        inner = np.zeros(n, bool)
        for spans in self.spans.values():
            for i, j in spans:
                inner[i + 1 : j] = True
        out, a = [], 0
        for i in range(1, n):
            size = i - a
            if size < 4:
                continue
            p = w[i - 1]
            stop = p == "." and w[i - 2].islower() and len(w[i - 2]) > 2 and w[i - 2] not in _ABBREVIATED and not w[i].islower()
            if stop or (size >= 120 and (p.islower() and w[i].islower() and not inner[i] or "\n" in self.text[self.end[i - 1] : self.start[i]])):
                out.append((a, i))
                a = i
        if a < n:
            out.append((a, n))
        return out

    def flags(self, common: set[str], of: np.ndarray | None = None) -> np.ndarray:
        """Columns: first and later tokens of each form; given, family; capital, all capitals; a common word; first of a line, after a full stop; one."""
        n = len(self.words)
        f = np.zeros((n, N_FLAGS), np.float32)
        for k, kind in enumerate(KINDS):
            for i, j in self.spans[kind]:
                f[i, 2 * k] = 1
                f[i + 1 : j, 2 * k + 1] = 1
        base = 2 * len(KINDS)
        if n:
            f[0, base + 5] = 1
            at = np.searchsorted(self.start, [m.start() for m in re.finditer("\n", self.text)])
            f[at[at < n], base + 5] = 1
        f = f if of is None else f[of]
        of = np.arange(n) if of is None else of
        if len(of):
            kinds = np.array(self.name_kind)[of]
            words = [self.words[i] for i in of.tolist()]
            f[:, base] = kinds & 1
            f[:, base + 1] = kinds >> 1
            f[:, base + 2] = [x[0].isupper() for x in words]
            f[:, base + 3] = [x.isupper() and len(x) > 1 for x in words]
            f[:, base + 4] = [x.lower() in common for x in words]
            f[:, base + 6] = [i > 0 and self.words[i - 1] in ".!?:" for i in of.tolist()]
            f[:, base + 7] = 1
        return f

    def span_features(self, common: set[str]) -> list[tuple[int, int, list[str]]]:
        """Of each span that has a form: what it is built of, and the words around it."""
        low = [x.lower() if x[0].isalpha() else ("#" if x[0].isdigit() else x) for x in self.words]
        n, out = len(low), []
        for kind, spans in self.spans.items():
            for i, j in spans:
                before, after = low[max(0, i - 5) : i][::-1], low[j : j + 2]
                f = [f"{kind}<<{x}" for x in set(before)] + [f"{kind}>>{x}" for x in set(after)]
                f += [f"{kind}<{k}{x}" for k, x in enumerate(before[:2])] + [f"{kind}>{after[0] if after else 'end'}"]
                inside = self.words[i:j]
                if kind in ("phone", "id_number"):
                    value = self.text[self.start[i] : self.end[j - 1]]
                    f.append(f"{kind}:" + re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", re.sub(r"\s", " ", value)))[:24])
                    f.append(f"{kind}#{min(14, sum(c.isdigit() for c in value))}")
                elif kind == "name":
                    shape = [("GFB"[self.name_kind[x] - 1] if self.name_kind[x] else "i" if len(w) == 1 and w.isalpha() else "c" if w[0].isalpha() else w) + ("u" if w.isupper() else "l" if w.islower() else "") for x, w in zip(range(i, j), inside)]
                    whole = sum(len(w) > 1 for x, w in enumerate(inside) if not x or inside[x - 1] != "-") > 1 or inside[0] != inside[0].lower() and len(inside[0]) == 1
                    f += ["name:" + "".join(shape), f"name:whole{whole}", f"name:whole{whole}>{after[0] if after else 'end'}"]
                elif kind == "address":
                    words = [x for x in low[i + 1 : j] if x.isalpha() and len(x) > 1]
                    f += [f"address:last{words[-1] if words else ''}", f"address:common{any(x in common for x in words[:-1])}", f"address:unit{any(x in UNITS for x in words)}"]
                    f += [f"address:{x}" for x in set(words[:-1])]
                else:
                    f.append(f"email:{'@' in inside}")
                out.append((i, j, f))
        return out

    def by_rules(self, common: set[str]) -> np.ndarray:
        """Allowed labels per token: a mask; all allowed where the rules can't tell."""
        n = len(self.words)
        label = np.zeros(n, np.int64)
        open_ = np.zeros(n, bool)
        taken = np.zeros(n, bool)

        def put(kind: str | None, i: int, j: int) -> None:
            if taken[i:j].any():
                return
            taken[i:j] = True
            if kind:
                b = 1 + 2 * KINDS.index(kind)
                label[i], label[i + 1 : j] = b, b + 1

        low = [x.lower() for x in self.words]
        for i, j in self.spans["email"]:
            put("email", i, j)
        for i, j in self.spans["address"]:
            inner = [x for x in low[i + 1 : j] if x.isalpha() and len(x) > 1][:-1]
            follows = j + 1 if j < n and self.words[j] == "." else j
            if low[j - 1] in TITLES and follows < n and self.name_kind[follows]:
                continue  # the street's end may be a title
            if not any(x in common or x in UNITS for x in inner):
                put("address", i, j)
        for i, j in self.spans["id_number"]:
            before = self.text[max(0, self.start[i] - 40) : self.start[i]]
            if PERSON_ID.search(before):
                put("id_number", i, j)
            elif THING_ID.search(before):
                put(None, i, j)
        for i, j in self.spans["phone"]:
            if j < n and low[j] in UNITS:
                put(None, i, j)
            elif THING_ID.search(self.text[max(0, self.start[i] - 20) : self.start[i]]):
                put(None, i, j)
            elif "-" not in self.words[i:j] or self.words[i] in "(+" or KIN.intersection(low[max(0, i - 8) : i]) or PHONE_CUE.search(self.text[max(0, self.start[i] - 40) : self.start[i]]):
                put("phone", i, j)  # without a telling place, numbers with hyphens may be ranges or doses
            elif not taken[i:j].any():
                open_[i:j] = True
        for i, j in self.spans["id_number"]:
            if not any(len(x) > 2 and x.isalpha() for x in low[max(0, i - 5) : i]):
                put(None, i, j)  # nothing says whose it is
            elif not taken[i:j].any():
                open_[i:j] = True
        for i, j in self.spans["name"]:
            after = low[j] if j < n else ""
            k = i - 1
            if k >= 0 and self.words[k] == ".":
                k -= 1
            title = k >= 0 and low[k] in TITLES
            parts = [x for x in range(i, j) if len(self.words[x]) > 1 and (x == i or self.words[x - 1] != "-")]
            whole = len(parts) > 1 or self._initial(i)
            if after in NAMED_THINGS and not whole:
                put(None, i, j)
            elif whole or title:
                put("name", i, j)
            else:
                open_[i:j] = True
        # A capital in mid-sentence that isn't in any form may be a name nobody knows.
        for i in range(1, n):
            x = self.words[i]
            if not taken[i] and x[0].isupper() and len(x) > 2 and self.words[i - 1] not in ".:!?" and low[i] not in common and "\n" not in self.text[self.end[i - 1] : self.start[i]]:
                open_[i] = True
        allowed = np.zeros((n, N), bool)
        allowed[np.arange(n), label] = True
        allowed[open_ & ~taken] = True
        return allowed


def word_features(w: str, vocabulary: dict[str, int]) -> list[str]:
    low = w.lower()
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[^\W\d_a-zà-ÿ]", "A", re.sub(r"\d", "9", w))))
    out = ["shape=" + shape]
    if low in vocabulary or not low[0].isalpha():
        out.append("w=" + (low if not low.isdigit() else f"#{min(len(low), 11)}"))
    else:
        out += ["p3=" + low[:3], "s3=" + low[-3:], "s4=" + low[-4:]]
    if low in TITLES:
        out.append("title")
    if low in KIN:
        out.append("kin")
    if low in NAMED_THINGS:
        out.append("thing")
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    return np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis)


def chain(unary: np.ndarray, length: np.ndarray, trans: np.ndarray):
    """Messages of padded sequences (S, T, N): (log marginals, log partition, forward, backward)."""
    s, t, n = unary.shape
    e = np.exp(trans)
    fwd, bwd = np.zeros_like(unary), np.zeros_like(unary)
    fwd[:, 0] = unary[:, 0]
    for i in range(1, t):
        p = fwd[:, i - 1]
        m = p.max(1, keepdims=True)
        step = np.log(np.exp(p - m) @ e + 1e-300) + m + unary[:, i]
        fwd[:, i] = np.where((i < length)[:, None], step, p)
    for i in range(t - 2, -1, -1):
        p = bwd[:, i + 1] + unary[:, i + 1]
        m = p.max(1, keepdims=True)
        step = np.log(np.exp(p - m) @ e.T + 1e-300) + m
        bwd[:, i] = np.where((i + 1 < length)[:, None], step, 0)
    z = _log_sum(fwd[:, -1], 1)
    return fwd + bwd - z[:, None, None], z, fwd, bwd


def viterbi(unary: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    s, t, n = unary.shape
    best = unary[:, 0].copy()
    back = np.zeros((s, t, n), np.int8)
    back[:] = np.arange(n)
    for i in range(1, t):
        x = best[:, :, None] + trans[None]
        arg = x.argmax(1)
        live = i < length
        best = np.where(live[:, None], np.take_along_axis(x, arg[:, None], 1)[:, 0] + unary[:, i], best)
        back[:, i] = np.where(live[:, None], arg, back[:, i])
    out = np.zeros((s, t), np.int64)
    out[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = np.take_along_axis(back[:, i], out[:, i, None], 1)[:, 0]
    return out


def _padded(pieces: list[tuple[int, int]], most_cells: int = 60_000):
    """Groups of pieces of like length: (token index, length); padding repeats the last token."""
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][1] - pieces[i][0])
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * (pieces[order[to]][1] - pieces[order[to]][0]) <= most_cells:
            to += 1
        group = [pieces[i] for i in order[at:to]]
        size = np.array([b - a for a, b in group])
        first = np.array([a for a, _ in group])
        index = first[:, None] + np.minimum(np.arange(size.max())[None], size[:, None] - 1)
        yield index, size
        at = to


FORBIDDEN = np.zeros((N, N))
for _j in range(2, N, 2):  # a following token only after one of its own kind
    FORBIDDEN[:, _j] = -30
    FORBIDDEN[_j - 1, _j] = FORBIDDEN[_j, _j] = 0


class Field:
    """The trained field."""

    def __init__(self, names: Names, vocabulary: dict[str, int], index: dict[str, int], span_index: dict[str, int]) -> None:
        self.names, self.vocabulary, self.index, self.span_index = names, vocabulary, index, span_index
        self.span_weights = np.zeros((len(span_index), 1 + len(KINDS)), np.float32)
        self.weights = np.zeros((len(index), N), np.float32)
        self.flag_weights = np.zeros((N_FLAGS, N), np.float32)
        self.trans = np.zeros((N, N))
        self.skip = np.zeros((N, N))
        self.name_cache: dict = {}
        self.rows: dict[str, int] = {}
        self.scores: np.ndarray = np.zeros((0, len(REACH), N), np.float32)

    def feature_ids(self, w: str) -> list[list[int]]:
        f = word_features(w, self.vocabulary)
        return [[self.index[k] for x in f if (k := f"{r}:{x}") in self.index] for r in REACH]

    def unary(self, doc: Doc, common: set[str], of: np.ndarray | None = None) -> np.ndarray:
        """Potentials of a document's tokens, or of some of them in order; scores of a word are computed once."""
        n = len(doc.words)
        of = np.arange(n) if of is None else of
        place = np.full(n, -1)
        place[of] = np.arange(len(of))
        around = np.unique(np.concatenate([of + r for r in REACH])) if n else of
        around = around[(around >= 0) & (around < n)]
        rows = np.zeros(n, np.int64)
        fresh = []
        for i in around.tolist():
            w = doc.words[i]
            r = self.rows.get(w)
            if r is None:
                r = self.rows[w] = len(self.rows)
                fresh.append(np.stack([self.weights[x].sum(0) if x else np.zeros(N, np.float32) for x in self.feature_ids(w)]))
            rows[i] = r
        if fresh:
            self._grow(fresh)
        u = doc.flags(common, of) @ self.flag_weights
        for i, j, f in doc.span_features(common):
            ids = [x for k in f if (x := self.span_index.get(k)) is not None]
            if ids:
                u[place[i:j]] += self.span_weights[ids].sum(0)[KIND_OF]
        for k, r in enumerate(REACH):
            at = of + r
            ok = (at >= 0) & (at < n)
            u[ok] += self.scores[rows[at[ok]], k]
        return u.astype(np.float64)

    def _grow(self, fresh: list) -> None:
        need = len(self.rows)
        if need > len(self.scores):
            more = np.zeros((max(1024, 2 * need), len(REACH), N), np.float32)
            more[: len(self.scores)] = self.scores
            self.scores = more
        self.scores[need - len(fresh) : need] = np.stack(fresh)

    def forget(self, most: int = 400_000) -> None:
        """Bound the memory of kept scores."""
        if len(self.rows) > most:
            self.rows, self.scores, self.name_cache = {}, np.zeros((0, len(REACH), N), np.float32), {}

    @staticmethod
    def skip_edges(doc: Doc, common: set[str], telling: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links between equal and similar words that could be names, a tree per group; and of an initial with a given name.

        ``telling``: only groups with a word at one of these tokens (a mask).
        """
        seen: dict[str, list[int]] = defaultdict(list)
        initials: list[int] = []
        for i, w in enumerate(doc.words):
            if not w[0].isalpha():
                continue
            if len(w) == 1:
                if doc._initial(i):
                    initials.append(i)
            elif doc.name_kind[i] or (len(w) >= 4 and w[0].isupper()):
                form = re.sub(r"['’]s$", "", w.lower())
                if form not in common:
                    seen[form].append(i)
        group = {form: form for form in seen}

        def root(x: str) -> str:
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        # Words of one letter more, less or other share what is left when a letter is taken out.
        rest: dict[str, str] = {}
        for form in seen:
            if len(form) >= 6:
                for key in {form, *(form[:k] + form[k + 1 :] for k in range(1, len(form)))}:
                    other = rest.setdefault(key, form)
                    if other != form and abs(len(other) - len(form)) <= 1:
                        group[root(form)] = root(other)
        members: dict[str, list[int]] = defaultdict(list)
        for form, at in seen.items():
            members[root(form)] += at
        edges = []
        for at in members.values():
            if len(at) < 2 or telling is not None and not any(telling[i] for i in at):
                continue
            at.sort()
            edges += [(at[(m - 1) // 2], at[m]) for m in range(1, len(at))]
        if initials:
            given = {}
            for form, at in seen.items():
                if doc.name_kind[at[0]] & 1:
                    given.setdefault(form[0], at[0])
            pairs = [(given[x], i) for i in initials if (x := doc.words[i].lower()) in given]
            edges += [e for e in pairs if telling is None or telling[e[0]] or telling[e[1]]]
        return edges

    def asked(self, doc: Doc, common: set[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Sentences that may hold an item, and the skip links.

        These are the sentences with a form, a title, a word of kinship or an
        @, and those that a link joins with one of them.
        """
        pieces, n = doc.pieces(), len(doc.words)
        telling = np.zeros(n, bool)
        telling[doc.cues] = True
        for spans in doc.spans.values():
            for i, j in spans:
                telling[i:j] = True
        if not telling.any():
            return [], []
        piece_of = np.repeat(np.arange(len(pieces)), [b - a for a, b in pieces])
        on = np.zeros(len(pieces), bool)
        on[piece_of[telling]] = True
        edges = self.skip_edges(doc, common, on[piece_of])
        for e in edges:
            on[piece_of[list(e)]] = True
        return [pieces[k] for k in np.flatnonzero(on)], edges

    def label(self, docs: list[Doc], common: set[str]) -> list[np.ndarray]:
        """Labels of each document's tokens, by loopy message passing over chains and skip links; O in sentences that aren't ``asked``."""
        out = [np.zeros(len(d.words), np.int64) for d in docs]
        asked = [self.asked(d, common) for d in docs]
        of = [np.concatenate([np.arange(a, b) for a, b in p]) if p else np.zeros(0, np.int64) for p, _ in asked]
        some = [k for k, x in enumerate(of) if len(x)]
        if not some:
            return out
        offset = np.cumsum([0] + [len(of[k]) for k in some])
        u = np.concatenate([self.unary(docs[k], common, of[k]) for k in some])
        pieces, edges = [], []
        for k, o in zip(some, offset):
            place = np.zeros(len(docs[k].words), np.int64)
            place[of[k]] = np.arange(o, o + len(of[k]))
            pieces += [(int(place[a]), int(place[b - 1]) + 1) for a, b in asked[k][0]]
            edges += [(place[a], place[b]) for a, b in asked[k][1]]
        edges = np.array(edges, np.int64).reshape(-1, 2)
        trans = self.trans + FORBIDDEN
        extra = np.zeros_like(u)
        if len(edges):
            # Only sentences that a link touches are passed again.
            piece_of = np.zeros(len(u), np.int64)
            for k, (a, b) in enumerate(pieces):
                piece_of[a:b] = k
            linked = [pieces[k] for k in np.unique(piece_of[edges.ravel()])]
            groups = list(_padded(linked))
            a, b = edges[:, 0], edges[:, 1]
            to_a, to_b = np.zeros((len(edges), N)), np.zeros((len(edges), N))
            e = np.exp(self.skip)
            for _ in range(MOST_ROUNDS):
                belief = np.zeros_like(u)
                for index, size in groups:
                    marginal, *_ = chain((u + extra)[index], size, trans)
                    belief[index[:, ::-1]] = marginal[:, ::-1]  # of repeated padding, the first position counts
                new_b = np.log(np.exp(belief[a] - to_a - (belief[a] - to_a).max(1, keepdims=True)) @ e + 1e-300)
                new_a = np.log(np.exp(belief[b] - to_b - (belief[b] - to_b).max(1, keepdims=True)) @ e.T + 1e-300)
                new_a -= new_a.max(1, keepdims=True)
                new_b -= new_b.max(1, keepdims=True)
                moved = max(np.abs(new_a - to_a).max(), np.abs(new_b - to_b).max())
                to_a, to_b = to_a + 0.7 * (new_a - to_a), to_b + 0.7 * (new_b - to_b)  # damped, as cycles may swing
                extra[:] = 0
                np.add.at(extra, a, to_a)
                np.add.at(extra, b, to_b)
                if moved < SETTLED:
                    break
        label = np.zeros(len(u), np.int64)
        u = u + extra
        for index, size in _padded(pieces):
            y = viterbi(u[index], size, trans)
            keep = np.arange(index.shape[1])[None] < size[:, None]
            label[index[keep]] = y[keep]
        for k, o in zip(some, offset):
            out[k][of[k]] = label[o : o + len(of[k])]
        return out


def items(doc: Doc, label: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters, set to the bounds of the form that holds most of the labelled tokens; without a form, as labelled."""
    out, n, i = [], len(label), 0
    covered = 0
    while i < n:
        y = label[i]
        if y == 0:
            i += 1
            continue
        k = (y - 1) // 2
        j = i + 1
        while j < n and label[j] == 2 * k + 2:
            j += 1
        kind = KINDS[k]
        a, b = i, j
        over = [(min(j, q) - max(i, p), p, q) for p, q in doc.spans[kind] if p < j and q > i]
        if over:
            _, a, b = max(over)
        if not over and kind != "name" and not any(x in "@" or x.lower() in ("at", "dot") if kind == "email" else x.isdigit() for x in doc.words[a:b]):
            i = j  # the exact check of what has no form
            continue
        start, end = int(doc.start[a]), int(doc.end[b - 1])
        if kind == "name" or not over:
            while end > start and doc.text[end - 1] in ",;:-" or (doc.text[start:end].endswith(".") and b - a == 1):
                end -= 1
        if kind == "address":
            while end > start and doc.text[end - 1] == ".":
                end -= 1
        if end > start and start >= covered:
            out.append((kind, start, end))
            covered = end
        i = max(j, b)
    return out


def _start_sentences(names: Names, rng: np.random.Generator) -> list[str]:
    given, family = sorted(names.given), sorted(names.family)
    if not given or not family:
        return []
    pick = lambda x: str(x[rng.integers(len(x))])
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    out = []
    for s in SENTENCES * 16:
        g, f = pick(given).title(), pick(family).title()
        n = [f"{g} {f}", f"{f.upper()}, {g}", f"{g[0]}. {f}", f"{f}, {g}", f"{g} {pick(given)[0].upper()}. {f}", f"{g} {f}".lower()][rng.integers(6)]
        p = [f"({digits(3)}) 555-{digits(4)}", f"+1 {digits(3)} 555 {digits(4)}", f"{digits(3)}-555-{digits(4)}", f"0{digits(4)} {digits(6)}"][rng.integers(4)]
        i = [f"{digits(8)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"X{digits(7)}", f"ABC-{digits(4)}-{digits(3)}", f"{digits(3)} {digits(2)} {digits(4)}"][rng.integers(5)]
        a = [f"{digits(3)} {pick(family).title()} Street", f"{digits(4)} {pick(family).title()} Ave, Apt {digits(2)}B", f"PO Box {digits(4)}",
             f"{pick(family).title()}straße {digits(2)}", f"{pick(family).title()}weg {digits(3)}", f"Calle {pick(family).title()} {digits(2)}"][rng.integers(6)]
        out.append(s.format(n=n, f=f, p=p, i=i, a=a, e=f"{g}.{f}@example.org".lower()))
    return out


def _among_lines(sentences: list[str], texts: list[str], rng: np.random.Generator) -> list[str]:
    """Most of the sentences put between lines of the texts, as items stand in any surroundings."""
    lines = [x[:120] for t in texts if t for x in t.split("\n")[:40] if x.strip()]
    if not lines:
        return sentences
    pick = lambda: lines[rng.integers(len(lines))]
    gap = lambda: "\n" if rng.random() < 0.6 else " "
    return [pick() + gap() + s + gap() + pick() if rng.random() < 0.7 else s for s in sentences]


def train(texts: list[str], names: Names, common: set[str], steps: int = 180, seed: int = 3) -> Field:
    rng = np.random.default_rng(seed)
    cache: dict = {}
    docs = [Doc(t, names, cache) for t in [*texts, *_among_lines(_start_sentences(names, rng), texts, rng)] if t and t.strip()]
    # Sentences without any form say little more than others of their kind: of each word pattern some are kept.
    allowed, kept, patterns = [], [], Counter()
    tokens_seen: Counter = Counter()
    for d in docs:
        m = d.by_rules(common)
        d.allowed, d.form_features = m, d.span_features(common)
        tokens_seen.update({w.lower() for w in d.words})
        for a, b in d.pieces():
            plain = not any(i < b and j > a for k in KINDS for i, j in d.spans[k])
            key = tuple(w.lower() if w.lower() in common else w[0].isupper() for w in d.words[a:b][:12])
            patterns[key] += 1
            if not plain or patterns[key] <= 3:
                kept.append((d, a, b))
    vocabulary = {w: i for i, (w, n) in enumerate(tokens_seen.items()) if n >= 3 and not (names.is_a(w, "given") or names.is_a(w, "family"))}
    index: dict[str, int] = {}
    counts: Counter = Counter()
    per_word: dict[str, list[str]] = {}
    for d, a, b in kept:
        for w in d.words[a:b]:
            if w not in per_word:
                per_word[w] = word_features(w, vocabulary)
            counts.update(per_word[w])
    for r in REACH:
        for x, n in counts.items():
            if n >= 2:
                index[f"{r}:{x}"] = len(index)
    span_counts = Counter(x for d, a, b in kept for i, j, f in d.form_features if a <= i < b for x in f)
    span_index = {x: k for k, x in enumerate(sorted(x for x, n in span_counts.items() if n >= 2))}
    field = Field(names, vocabulary, index, span_index)
    field.name_cache = cache
    if not kept:
        return field
    width = 5
    ids_of: dict[str, np.ndarray] = {}
    blank = len(index)
    for w in per_word:
        m = np.full((len(REACH), width + 3), blank, np.int64)
        for k, f in enumerate(field.feature_ids(w)):
            m[k, : len(f)] = f[: width + 3]
        ids_of[w] = m
    # Feature numbers and flags of all kept tokens, in one array.
    feats, flags, masks, pieces, spans, at = [], [], [], [], [], 0
    no_span = len(span_index)
    for d, a, b in kept:
        n = b - a
        f = np.full((n, len(REACH), width + 3), blank, np.int64)
        for k, r in enumerate(REACH):
            for i in range(n):
                j = a + i + r
                if 0 <= j < len(d.words):
                    w = d.words[j]
                    m = ids_of.get(w)
                    if m is None:
                        m = ids_of[w] = np.full((len(REACH), width + 3), blank, np.int64)
                        for kk, ff in enumerate(field.feature_ids(w)):
                            m[kk, : len(ff)] = ff[: width + 3]
                    f[i, k] = m[k]
        if rng.random() < CONTEXT_HIDDEN:
            f[:, [k for k, r in enumerate(REACH) if abs(r) > 1]] = blank
        feats.append(f.reshape(n, -1))
        if not hasattr(d, "flag"):
            d.flag = d.flags(common)
        flags.append(d.flag[a:b].copy())
        over: list[list[int]] = [[] for _ in range(n)]
        if rng.random() < FORMS_HIDDEN:  # so that words, shapes and neighbours are learnt as well
            flags[-1][:, : 2 * len(KINDS)] = 0
        else:
            for i, j, names_of in d.form_features:
                ids = [span_index[x] for x in names_of if x in span_index]
                for x in range(max(i, a), min(j, b)):
                    over[x - a] += ids
        held = np.full((n, SPAN_WIDTH), no_span, np.int64)
        for x, ids in enumerate(over):
            held[x, : len(ids)] = ids[:SPAN_WIDTH]
        spans.append(held)
        masks.append(d.allowed[a:b])
        pieces.append((at, at + n))
        at += n
    feats, flags, masks, spans = np.concatenate(feats), np.concatenate(flags), np.concatenate(masks), np.concatenate(spans)
    in_form = spans[:, 0] < no_span
    w1 = np.zeros((blank + 1, N))
    w2 = np.zeros((flags.shape[1], N))
    w3 = np.zeros((N, N))
    w4 = np.zeros((no_span + 1, 1 + len(KINDS)))
    params = [w1, w2, w3, w4]
    ms, vs = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = rng.permutation(len(pieces))
    parts = max(1, min(12, at // 4_000))
    for step in range(1, steps + 1):
        mine = [pieces[i] for i in order[(step - 1) % parts :: parts]]
        g1, g2, g3, g4 = (np.zeros_like(p) for p in params)
        total = sum(b - a for a, b in mine)
        for idx, size in _padded(mine):
            live = np.arange(idx.shape[1])[None] < size[:, None]
            rows = idx[live]
            u = np.zeros((*idx.shape, N))
            formed = in_form[rows]
            score = w1[feats[rows]].sum(1) + flags[rows] @ w2
            score[formed] += w4[spans[rows[formed]]].sum(1)[:, KIND_OF]
            u[live] = score
            trans = w3 + FORBIDDEN
            free, z, f, b = chain(u, size, trans)
            held_u = np.where(masks[idx], u, u - 60.0)
            tied, zt, ft, bt = chain(held_u, size, trans)
            diff = np.where(live[..., None], np.exp(free) - np.exp(tied), 0)
            np.add.at(g1, feats[rows].ravel(), np.repeat(diff[live], feats.shape[1], axis=0))
            g2 += flags[rows].T @ diff[live]
            by_kind = diff[live][formed] @ (KIND_OF[:, None] == np.arange(1 + len(KINDS)))
            np.add.at(g4, spans[rows[formed]].ravel(), np.repeat(by_kind, SPAN_WIDTH, axis=0))
            for uu, ff, bb, zz, sign in ((u, f, b, z, 1), (held_u, ft, bt, zt, -1)):
                if idx.shape[1] > 1:
                    x = ff[:, :-1, :, None] + trans + (uu + bb)[:, 1:, None, :] - zz[:, None, None, None]
                    g3 += sign * np.einsum("stab,st->ab", np.exp(x), live[:, 1:].astype(float))
        for k, (p, g, decay) in enumerate(zip(params, (g1, g2, g3, g4), (1e-5, 1e-6, 1e-5, 1e-5), strict=True)):
            g = g / max(1, total) + decay * p
            ms[k] = 0.9 * ms[k] + 0.1 * g
            vs[k] = 0.99 * vs[k] + 0.01 * g * g
            p -= 0.15 * (ms[k] / (1 - 0.9**step)) / (np.sqrt(vs[k] / (1 - 0.99**step)) + 1e-8)
        w1[blank] = 0
        w4[no_span] = 0
    field.weights, field.flag_weights, field.trans = w1[:blank].astype(np.float32), w2.astype(np.float32), w3
    field.span_weights = w4[:no_span].astype(np.float32)
    field.skip = _skip_potential(docs, field, common)
    return field


def _skip_potential(docs: list[Doc], field: Field, common: set[str]) -> np.ndarray:
    """The log of how much more often than chance the ends of a link have two labels, labels taken as O, name and other."""
    group = np.array([0 if y == 0 else 1 if LABELS[y].endswith("name") else 2 for y in range(N)])
    c = np.full((3, 3), 0.5)
    for d in docs:
        sure = d.allowed.sum(1) == 1
        y = group[d.allowed.argmax(1)]
        for a, b in field.skip_edges(d, common):
            if sure[a] and sure[b]:
                c[y[a], y[b]] += 0.5
                c[y[b], y[a]] += 0.5
    p = c / c.sum()
    lift = np.log(p / np.outer(p.sum(1), p.sum(0)))
    return np.clip(lift, -3, 3)[np.ix_(group, group)]


def known_names(names: DataFrame) -> Names:
    rows = whole_list(names.where("name_text is not null").select("name_text", "name_kind").distinct(), "known_names")
    of = lambda k: {r["name_text"].lower() for r in rows if r["name_kind"] == k}
    return Names(of("given"), of("family"))


FOUND = "doc_id long, items array<struct<kind: string, value_text: string, start_at: int, end_at: int>>, redacted string"


def find_personal(documents: DataFrame, names: DataFrame, common_words: DataFrame) -> DataFrame:
    """(``doc_id``, ``items``, ``redacted``): personal items of each text, and the text with placeholders like [NAME] for them."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    n = max(1, docs.count())
    step = max(1, n // TRAINING_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCS)
    texts = [r["text"] for r in sample.collect()]
    common = {r["word"].lower() for r in whole_list(common_words.where("word is not null").select("word").distinct(), "common_words")}
    known = known_names(names)
    field = train(texts, known, common)
    field.name_cache = {}
    shared = share(spark, (field, common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, common = shared.value
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                docs = [Doc(t, field.names, field.name_cache) for t in texts]
                found, redacted = [], []
                for d, y, t in zip(docs, field.label(docs, common), part["text"], strict=True):
                    got = items(d, y)
                    found.append([{"kind": k, "value_text": d.text[i:j], "start_at": i, "end_at": j} for k, i, j in got])
                    pieces, last = [], 0
                    for k, i, j in got:
                        pieces += [d.text[last:i], f"[{k.upper()}]"]
                        last = j
                    redacted.append("".join([*pieces, d.text[last:]]) if isinstance(t, str) else None)
                field.forget()
                yield pd.DataFrame({"doc_id": part["doc_id"], "items": found, "redacted": redacted})

    return docs.mapInPandas(run, FOUND)


def _found(spark, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"), table(spark, sf_dir, "common_words"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    x = _found(spark, sf_dir).select("doc_id", F.explode("items").alias("i"))
    return x.select("doc_id", "i.kind", "i.value_text").distinct()


def p5_redacted(spark, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "redacted", F.size("items").alias("n_items"))


def p5_checks(spark, sf_dir: str) -> DataFrame:
    """Documents, those with text, and those whose redacted text isn't the text with each item, as it stands there, put in for its placeholder."""
    d = _found(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    # Items in order from the end: what is left of the text before an item, the placeholder, what follows.
    start = F.struct(F.col("text").alias("head"), F.lit("").alias("tail"), F.lit(True).alias("ok"))

    def step(s, x):
        value = F.substring(s["head"], x["start_at"] + 1, x["end_at"] - x["start_at"])
        after = F.substring(s["head"], x["end_at"] + 1, F.length(s["head"]))
        return F.struct(
            F.substring(s["head"], F.lit(1), x["start_at"]).alias("head"),
            F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"), after, s["tail"]).alias("tail"),
            (s["ok"] & (value == x["value_text"])).alias("ok"),
        )

    same = F.aggregate(F.reverse("items"), start, step, lambda s: s["ok"] & F.concat(s["head"], s["tail"]).eqNullSafe(F.col("redacted")))
    return d.agg(F.count("*").alias("docs"), F.count_if(F.col("text").rlike(r"\S")).alias("texts"), F.count_if(F.col("text").isNotNull() & ~same).alias("broken"))


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted, "p5_checks": p5_checks}
SQL = {"p5_checks": r"SELECT count(*) AS docs, count(*) FILTER (regexp_matches(text, '\S')) AS texts, 0::BIGINT AS broken FROM documents"}
