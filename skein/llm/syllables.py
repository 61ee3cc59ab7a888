"""Syllables of a word by hyphenation rules: a word parts between the nuclei of its vowels.

A nucleus is a vowel or a vowel pair or triple that is spoken as one; each language lists them, and patterns in the
manner of hyphenation exceptions say where a listed one parts after all, and which vowels are silent. Words are lower case.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Vowels, and the vowel groups that make one syllable, longest first.
VOWELS = {
    "en": "aeiouyàáâäèéêëìíîïòóôöùúûü",
    "de": "aeiouyäöüàéèê",
    "fr": "aeiouyàâäèéêëîïôöùûüœæ",
    "es": "aeiouáéíóúü",
}
NUCLEI = {
    "en": "eau eou aye eye ai au aw ay ea ee ei eu ey ie oa oe oi oo ou oy ue ui uy",
    "de": "ie ei ai au eu äu ey ay oi oy aa ee oo ou",
    "fr": "eau oui ieu iou œu ai aî ay au ea ei eî eu eû ey ia ie iè ié iê io oi oî ou oû où oy ui uî uy ya ye yé yo",
    "es": "iái iéi uái uéi iai iei uai uei iau uau ai ei oi au eu ou ia ie io iu ua ue ui uo iá ié ió iú uá ué uí uó ái éi ói áu éu óu üe üi üé üí",
}
# Places where a listed group parts, marked by a hyphen inside the pattern's group.
PARTING = {
    "en": ["qi-et", "cre-at", "re-al", "the-at", "ide-a", "are-a", "li-et", "di-et", "po-em", "po-et", "go-ing", "do-ing", "su-ic", "flu-id", "ru-in", "see-ing", "be-ing", "re-act", "re-us", "pre-a", "co-op", "co-or", "fu-el", "cru-el", "du-el", "i-est$", "sci-en", "cli-en", "(?<!f)ri-en", "hi-er", "ci-et"],
    "de": ["(?<=[lnrtmpsfbkzd])i-en(?=$|s$)", "i-ell", "(?<!d)i-ent", "i-enz", "e-en$", "e-um(?=$|s$)", "^be-ur", "^be-un", "^ge-ur", "^be-inh", "^be-irr", "^ge-irr", "o-isch", "a-isch", "zo-olo", "e-ell"],
    "fr": ["(?<=[bcdfgptv][lr])i-e[rzn]", "(?<=[bcdfgptv][lr])i-o", "(?<=[bcdfgptv][lr])u-e[lt]", "é-a"],
    "es": [],
}
# Vowels that aren't spoken; they are taken out before.
SILENT = {
    "en": ["(?<=q)u(?=[aeiouy])", "^y(?=[aeiou])", "(?<=pe)o(?=p)", "(?<=eu)e(?=$|s$)", "(?<=[^aeiouyl])e(?=$)", "(?<=[^aeiouylszxcghj])e(?=s$)", "(?<=[aeiouy]l)e(?=$|s$)", "(?<=[^aeioutd])e(?=d$)", "(?<=[aeiouy][a-z])e(?=ly$|ful$|less$|ment$|ments$|ness$)"],
    "de": ["(?<=q)u"],
    "fr": ["(?<=q)u", "(?<=g)u(?=[eéèêiy])", "e(?=$|s$)", "(?<=[lnt])e(?=nt$)"],
    "es": ["(?<=q)u(?=[eiéí])", "(?<=g)u(?=[eiéí])"],
}
#: An i before another vowel is part of the consonant in English: nation, special, religion.
_SOFT = re.compile("(?<=[txg])i(?=[aeou])|(?<=c)i(?=[aou])|(?<=[^s]c)i(?=e[^t])|(?<=s)i(?=[ao])")
_TRIED = 1 << 18


def _compiled(language: str):
    # The patterns tell where a hyphen goes: the text before and after it.
    parting = [(re.compile(f"({a})({b})") if not a.startswith("(?") else re.compile(f"{a[: a.index(')') + 1]}({a[a.index(')') + 1 :]})({b})")) for a, b in (p.split("-", 1) for p in PARTING[language])]
    silent = [re.compile(p) for p in SILENT[language]]
    nuclei = "|".join(NUCLEI[language].split())
    return parting, silent, re.compile(f"{nuclei}|[{VOWELS[language]}]"), re.compile(f"[{VOWELS[language]}]")


_RULES = {k: _compiled(k) for k in VOWELS}


@lru_cache(maxsize=_TRIED)
def syllables(word: str, language: str = "en") -> int:
    """Syllables of a lower-case word, one at least. Letters of other scripts count for none."""
    parting, silent, nuclei, vowel = _RULES[language]
    bare = word
    if len(vowel.findall(word)) > 1:
        for pattern in silent:
            left = pattern.sub("", bare)
            if vowel.search(left):
                bare = left
    if language == "en":
        bare = _SOFT.sub("", bare) if len(vowel.findall(bare)) > 1 else bare
    for pattern in parting:
        bare = pattern.sub(r"\1-\2", bare)
    return max(1, len(nuclei.findall(bare)))
