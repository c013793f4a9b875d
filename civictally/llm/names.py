"""Comparing names typed by people: normal forms, phonetic codes, Jaro-Winkler, nicknames."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words that go with a name but do not belong to it.
TITLES = frozenset("mr mrs ms miss dr hon prof rev the of and".split())
# Texts that name no donor.
NO_DONOR = re.compile(r"^(?:unitemized\b.*|non ?itemized\b.*|(?:.*\b)?matching funds\b.*|interest|interest (?:income|earned|payment)s?|anonymous)$")
# Usual short forms of words in names of organisations.
SHORT_WORDS = {
    "cmte": "committee", "comm": "committee", "cttee": "committee", "assn": "association",
    "assocs": "associates", "lcl": "local", "loc": "local", "wkrs": "workers", "ptnrshp": "partnership", "co": "company",
    "corp": "corporation", "inc": "incorporated", "ltd": "limited", "un": "union", "elec": "electrical", "dept": "department",
    "intl": "international", "natl": "national", "govt": "government", "mgmt": "management", "svcs": "services", "bros": "brothers",
}
# Whole phrases that have an abbreviation.
PHRASES = {("political", "action", "committee"): "pac", ("limited", "liability", "company"): "llc"}
# Words that mark an organisation.
ORGANISATION = frozenset(
    "pac llc llp lp incorporated corporation company limited committee union local association associates partnership partners group "
    "holdings trust foundation fund league club council society institute center department workers owners".split()
)
# Nicknames and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alfred", "alex": "alexander alexandra alejandro", "andy": "andrew", "drew": "andrew",
    "angie": "angela", "barb": "barbara", "barbie": "barbara", "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine katherine",
    "charlie": "charles", "chuck": "charles", "chris": "christopher christine christina", "cindy": "cynthia", "dan": "daniel",
    "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald", "ed": "edward edwin",
    "eddie": "edward", "ellie": "eleanor elena", "fran": "francisco frances", "frank": "francisco francis franklin", "fred": "frederick alfred",
    "gabe": "gabriel", "greg": "gregory", "hank": "henry", "jack": "john", "jackie": "jacqueline", "jamie": "james", "jake": "jacob", "jeff": "jeffrey",
    "jen": "jennifer", "jenny": "jennifer", "jess": "jessica", "jessie": "jessica", "jim": "james", "jimmy": "james", "joe": "joseph jose",
    "joey": "joseph", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth kenji",
    "larry": "lawrence", "len": "leonard", "liz": "elizabeth", "lupe": "guadalupe", "maggie": "margaret", "manny": "manuel",
    "marge": "margaret", "matt": "matthew", "meg": "margaret", "mickey": "michael", "mike": "michael", "nate": "nathan nathaniel",
    "nick": "nicholas", "paco": "francisco", "pam": "pamela", "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia",
    "peg": "margaret", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "ray": "raymond", "becky": "rebecca",
    "becca": "rebecca", "rich": "richard", "rick": "richard", "ricky": "richard", "rob": "robert", "ron": "ronald", "ronnie": "ronald",
    "sam": "samuel samantha", "sandy": "sandra alexandra", "steve": "steven stephen", "sue": "susan", "susie": "susan", "ted": "edward theodore",
    "teddy": "edward theodore", "terry": "theresa terence", "tess": "theresa", "tim": "timothy", "tom": "thomas", "tommy": "thomas",
    "tony": "anthony antonio", "trish": "patricia", "val": "valerie", "vicky": "victoria", "vic": "victor victoria", "vince": "vincent",
    "walt": "walter", "will": "william", "zach": "zachary", "zack": "zachary", "betsy": "elizabeth", "beto": "roberto", "debby": "deborah",
    "eliza": "elizabeth", "jenn": "jennifer", "lucy": "lucia", "marty": "martin martha", "nicky": "nicholas nicole", "patti": "patricia",
    "rafa": "rafael", "stan": "stanley", "tori": "victoria", "tricia": "patricia",
}
# Spellings of one given name.
SPELLINGS = {
    "catherine": "katherine", "cathryn": "katherine", "debora": "deborah", "geoffrey": "jeffrey", "jeffery": "jeffrey", "jon": "jonathan john",
    "mathew": "matthew", "michelle": "michele", "philip": "phillip", "sara": "sarah", "stephen": "steven", "teresa": "theresa",
}
# Common given names, one spelling of each; two of them are different names, however alike.
GIVEN = frozenset(
    "aaron adam adriana aisha alan alberto alejandra alfredo alice alicia alma amanda amy ana andrea angel ann anna antonia arturo ashley aurora "
    "beatriz bernard bonnie brandon brenda brian bruce bruno camila carla carlos carmen carol caroline celia cesar claire clara claudia craig "
    "dalia david dean denise dennis diana diane diego dolores donna doris dylan eduardo elaine elsa emily emma enrique erica eric ernesto esther ethan eva "
    "farah felix fernando gabriel gabriela gary gerald gloria grace greta guillermo hana hannah harold hector helen hugo imani ines irene iris isaac isabel ivan "
    "jane jason javier jerry jesus joan joel jorge joyce juan juana judith julia julio justin karen karim kevin kyle laila laura leah lena leo lillian linda lisa lorenzo louis luis luz "
    "manuela marco maria mariana marie marina mario marisol mark marta mary maya melissa miguel mila mina monica nadia nancy natalie nelson nestor nina noor norma nora "
    "olga oliver olivia omar oscar pablo paul paula pedro petra priya quinn rachel ralph ramon raul rita rosa rose roy ruben ruth ryan salvador santiago sarah scott sean sergio sharon silvia sofia soren stella "
    "tamara tania tariq teresita tina tomas uma veronica vera virginia wendy xavier yolanda yuki zoe".split()
)
# Common family names that are like one another; each is a name of its own.
FAMILY = frozenset(
    "alvarez anderson barnes barrera berry brown burke burns byrne carter castillo castro chan chang chen cheng chung cole collins cook cooper cox craig cruz "
    "daniel daniels davis diaz evans fernandez fisher flores franco garcia garza gomez gonzalez graham grant gray green greer hall harper harris hart hayes hernandez hill "
    "jackson jacobs jensen johnson johnston jones kelley kim lane lang lee leon lewis lin liu long lopez luna marin martin martinez mason mendez mendoza meyer miller mills molina moore mora morales moreno morgan morris "
    "munoz murray myers nelson nguyen ochoa olsen ortega ortiz parker patel perez perry peters peterson price ramirez ramos reed reyes rios rivas rivera robinson rojas roman romero rosales ruiz "
    "salas salazar salinas sanchez santos shaw silva simmons simon smith solis soto stone suarez tran trujillo valdez vargas vasquez vega walker wang ward watson webb white wong wood wright wu yang young zhang".split()
)
_FORMAL = {k: tuple(v.split()) for k, v in (NICKNAMES | SPELLINGS).items()}
#: Words that are names of their own: no slip turns one into another.
OWN_NAMES = GIVEN | FAMILY | frozenset(NICKNAMES) | frozenset(f for v in _FORMAL.values() for f in v)
_MARKS = re.compile(r"[.'’‘`\"“”]")
_WORD = re.compile(r"[^\W_]+")


def normal_form(text: str | None) -> str:
    """Sorted words of a name without accents, case, titles and punctuation, short
    words written out; empty if the text names no donor."""
    if not text:
        return ""
    folded = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    words = _WORD.findall(_MARKS.sub("", folded.lower()))
    if not words or NO_DONOR.match(" ".join(words)):
        return ""
    if len(words) > 2:
        words = [SHORT_WORDS.get(w, w) for w in words]
        for phrase, short in PHRASES.items():
            if all(p in words for p in phrase):
                words = [w for w in words if w not in phrase] + [short]
    return " ".join(sorted([w for w in words if w not in TITLES] or words))


@lru_cache(200_000)
def phonetic(word: str) -> str:
    """Consonants as they sound, in order; an initial vowel as a."""
    w = word.replace("ph", "f").replace("ck", "k").translate(_SOUND)
    w = _DOUBLE.sub(r"\1", _SILENT.sub("", w))
    return ("a" if w[:1] in "aeiou" else "") + w.translate(_NO_VOWELS)


_SOUND = str.maketrans({"c": "k", "q": "k", "z": "s", "y": "i", "w": "v", "j": "g", "x": "ks"})
_NO_VOWELS = str.maketrans("", "", "aeiou")
_SILENT, _DOUBLE = re.compile(r"(?<=[^aeiou])h"), re.compile(r"(.)\1+")


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used = [False] * m
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    k = len(hits)
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def formal(word: str) -> tuple[str, ...]:
    return _FORMAL.get(word, (word,))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours makes them equal."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > 1:
        return False
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if n < m:
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


# Marks of a generation.
GENERATIONS = frozenset(("jr", "sr", "ii", "iii", "iv"))


class Name:
    """The parts of a normal form. ``middle`` are the given names of a person of three
    full words that a shorter form may leave out."""

    __slots__ = ("full", "initials", "marks", "middle", "person")

    def __init__(self, form: str):
        words = form.split(" ")
        self.marks = tuple(w for w in words if w in GENERATIONS or not w.isalpha())
        self.full = tuple(w for w in words if len(w) > 1 and w not in self.marks)
        self.initials = tuple(w for w in words if len(w) == 1 and w not in self.marks)
        human = all(w in GENERATIONS for w in self.marks) and ORGANISATION.isdisjoint(self.full)
        self.person = len(self.full) <= 2 and human
        given = [w for w in self.full if w in GIVEN or w in _FORMAL or w in _FORMALS] if human and len(self.full) == 3 else []
        self.middle = tuple(given) if len(given) > 1 else ()


_FORMALS = frozenset(f for v in _FORMAL.values() for f in v)


#: Letters of an end, and the shortest and longest word that has such.
_END_SIZES = ((2, 0, 6), (3, 5, 8), (4, 7, 1 << 30))


def _ends(word: str, person: bool = True) -> list[str]:
    """Beginnings and endings of which an edit leaves one as it is, longer ones of longer
    words; words whose lengths differ by one have a length of ends in common. A long word of
    an organisation has also the beginning that its abbreviations have."""
    sizes = [k for k, least, most in _END_SIZES if least <= len(word) <= most]
    short = [] if person or 3 in sizes or len(word) < 5 else ["<" + word[:3]]
    return [end for k in sizes for end in ("<" + word[:k], ">" + word[-k:])] + short
#: An edit in the middle of a word so short can change both of its ends.
SHORT = 4


def _word_keys(word: str) -> list[str]:
    """What a word shares with each of its slips: the sound, an end, or for short words
    the word without a letter."""
    out = [phonetic(word), *_ends(word)]
    if len(word) <= SHORT:
        out += ["-" + word[:i] + word[i + 1 :] for i in range(len(word))]
    return out


def _pair_key(a: str, b: str) -> str:
    return " ".join(sorted((phonetic(a), phonetic(b))))


def block_keys(name: Name) -> set[str]:
    """Blocks in which the form meets its variants: the phonetic codes of its sorted
    words, and all codes but one with an end of the word left out, or without it where
    that is short. A single word is known by itself; a person's with initials
    meets by ``asking_keys``."""
    words = name.full
    tail = "#" + " ".join(name.marks) if name.marks else ""
    if len(words) < 2:
        return {f"1{k}{tail}" for w in words for k in _word_keys(w)} if not (name.person and name.initials) else set()
    choices = [[w] for w in words]
    if name.person:
        choices = [list(formal(w)) for w in words]
    keys = set()
    for w0 in choices[0]:
        for w1 in choices[1]:
            chosen = [w0, w1, *words[2:]]
            codes = [phonetic(w) for w in chosen]
            keys.add(" ".join(sorted(codes)) + tail)
            for i, w in enumerate(chosen):
                rest = " ".join(sorted(codes[:i] + codes[i + 1 :]))
                keys.update(f"{rest} {e}{tail}" for e in _ends(w, name.person))
                if len(words[i]) <= SHORT or len(w) <= SHORT:
                    keys.add(f"{rest} -{tail}")
    return keys


def asking_keys(name: Name) -> tuple[set[str], set[str]]:
    """Where a form that leaves something open looks for the form that tells it, and where
    a form is found. One full word with initials looks for the given name, a person with
    middle names for the form without one."""
    if name.middle:
        rest = [[w for w in name.full if w is not m] for m in name.middle]
        return {f"+{_pair_key(x, y)}" for p, q in rest for x in formal(p) for y in formal(q)}, set()
    if not name.person or not name.full:
        return set(), set()
    if len(name.full) == 1:
        own = {f"{k} {i}" for k in _word_keys(name.full[0]) for i in name.initials}
        return own, own
    a, b = name.full
    found = {f"+{_pair_key(x, y)}" for x in formal(a) for y in formal(b)}
    for x, y in ((a, b), (b, a)):
        # a given name beside the initial of a family name is looked up by its sound only
        keys = [phonetic(x)] if x in GIVEN or x in _FORMAL else _word_keys(x)
        found |= {f"{k} {i}" for i in {f[0] for f in (y, *formal(y))} for k in keys}
    return set(), found


#: Least Jaro-Winkler similarity at which two words count as one by itself.
ALIKE = 0.95
#: The same for a long word that is within two edits of a listed given name.
ALIKE_GIVEN = 0.88
LONG = 6
#: Least Jaro-Winkler similarity of two words of one sound.
ALIKE_SOUND = 0.85
#: A word longer than that is no typed name: it has slips of a single edit only.
LONGEST = 64


def edits(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


@lru_cache(400_000)
def _slip(a: str, b: str) -> bool:
    """Whether two words that are not both names of their own are spellings of one word."""
    if one_edit(a, b):
        return True
    longer = max(len(a), len(b))
    if longer > LONGEST:
        return False
    sound = phonetic(a) == phonetic(b)
    given = (a in GIVEN or a in _FORMALS) != (b in GIVEN or b in _FORMALS)
    # without a common first letter two edits leave less than ALIKE in a word so short
    if not sound and not given and a[0] != b[0] and longer < 14:
        return False
    likeness = jaro_winkler(a, b)
    if likeness >= ALIKE or (likeness >= ALIKE_SOUND and sound):
        return True
    return given and likeness >= ALIKE_GIVEN and min(len(a), len(b)) >= LONG and edits(a, b) <= 2


def _word_score(a: str, b: str, own: frozenset = OWN_NAMES) -> float:
    """Jaro-Winkler similarity of two words that count as one, else 0; at least 0.9 for a
    slip, 0.97 for a nickname."""
    if a == b:
        return 1.0
    if set(formal(a)) & set(formal(b)):
        return 0.97
    if a in own and b in own:
        return 0.0
    if _slip(a, b):
        return max(0.9, jaro_winkler(a, b))
    # a slip of the name that a nickname stands for
    if any(one_edit(f, b) for f in _FORMAL.get(a, ())) or any(one_edit(f, a) for f in _FORMAL.get(b, ())):
        return 0.9
    return 0.0


def _short_for(a: str, b: str) -> float:
    """Whether one word of an organisation's name abbreviates the other: same first
    letter and the rest in order."""
    if len(a) > len(b):
        a, b = b, a
    if a[0] != b[0] or len(a) < 2 or len(a) > 0.75 * len(b):
        return 0.0
    letters = iter(b)
    return 0.95 if all(c in letters for c in a) else 0.0


@lru_cache(50_000)
def parsed(form: str) -> Name:
    return Name(form)


def _nested(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return set(a) <= set(b) or set(b) <= set(a)


def _pair_score(a: tuple[str, ...], b: tuple[str, ...], own: frozenset) -> list[float]:
    """Scores of two words against two, in the order in which both count as one."""
    (p, q), (r, s) = a, b
    for x, y in ((r, s), (s, r)):
        first = _word_score(p, x, own)
        second = _word_score(q, y, own) if first else 0.0
        if second:
            return [first, second]
    return [0.0, 0.0]


def compare(left: str, right: str, own: frozenset = OWN_NAMES) -> float:
    """0 to 1: how far two normal forms name the same; accepted from ACCEPT on.

    Words are compared by Jaro-Winkler (see ``_word_score``). Numbers and generation
    marks must agree. Two words of ``own`` are different words, however alike (Maria and
    Marta). The answer depends on the two forms only."""
    a, b = parsed(left), parsed(right)
    if a.marks != b.marks:
        return 0.0
    for x, y in ((a, b), (b, a)):
        if x.middle and y.person and len(y.full) == 2:
            return _without_middle(x, y, own)
    if a.person != b.person:
        return 0.0
    if a.person and min(len(a.full), len(b.full)) == 1 != max(len(a.full), len(b.full)):
        return _with_initials(a, b, own) if len(a.full) == 1 else _with_initials(b, a, own)
    if len(a.full) != len(b.full) or not a.full:
        return 0.0
    if a.person and len(a.full) == 1:
        if a.initials and b.initials and not _nested(a.initials, b.initials):
            return 0.0
        return _word_score(a.full[0], b.full[0], own)
    if a.initials and b.initials and a.initials != b.initials:
        return 0.0
    if len(a.full) == 2:
        scores = _pair_score(a.full, b.full, own)
    else:
        rest = list(b.full)
        scores = []
        for w in sorted(a.full, key=lambda w: w not in rest):
            best = max(rest, key=lambda x: max(_word_score(w, x, own), _short_for(w, x)))
            scores.append(max(_word_score(w, best, own), _short_for(w, best)))
            rest.remove(best)
    if min(scores) < 0.9 or sum(s < 0.97 for s in scores) > 1 + (len(scores) > 3):
        return 0.0
    return sum(scores) / len(scores)


def _with_initials(short: Name, whole: Name, own: frozenset) -> float:
    if not short.initials:
        return 0.0
    best = 0.0
    for last, first in (whole.full, whole.full[::-1]):
        letters = {f[0] for f in (first, *formal(first))}
        given = [i for i in short.initials if i in letters]
        if given:
            others = list(short.initials)
            others.remove(given[0])
            if not others or not whole.initials or _nested(tuple(others), whole.initials):
                best = max(best, _word_score(short.full[0], last, own))
    return best


def _without_middle(whole: Name, short: Name, own: frozenset) -> float:
    """A person with a middle name against a form that leaves it out or gives its initial."""
    best = 0.0
    for m in whole.middle:
        rest = tuple(w for w in whole.full if w is not m)
        if short.initials and not set(short.initials) <= {m[0], *whole.initials}:
            continue
        scores = _pair_score(rest, short.full, own)
        if min(scores) >= 0.97:
            best = max(best, 0.95 * sum(scores) / 2)
    return best
