"""Which language a short text is in: scripts, then small words and letters of Latin-script languages."""

from __future__ import annotations

import re

#: Common small words; a fixed list for each language.
SMALL_WORDS = {
    "en": "the a an of to and in is are was were that this it for with on as at by from not or be you can which then than into if when while but your after before because both only how what why should would there their give me three ways without any no nobody still once under about have has had does do them us our we i my some all more most",
    "de": "der die das und ist nicht ein eine einen dem den des zu mit auf für von im war wurde werden ich sie es dass wenn wie kann man nach bei oder aber auch noch ohne bevor obwohl weil sollte zuerst wir haben gesehen dann am warum passiert unter etwa bitte erkläre jede ohne seit beim einem einer niemand daran liegt ihr unser mein meine",
    "fr": "le la les des du un une et est dans que qui ne pas pour avec sur au aux par plus ce cette il je nous vous être sont avant puis sans depuis lors après comme où cas été a de d'abord faut se s'est l'ordre n'est",
    "es": "el la los las un una y es en que no por con para del al se lo como más pero sus ya o este si antes luego después primero hay han hemos sin desde cuando qué cómo puedo porque volvió de",
    "it": "il lo gli un una e è di che non per con del della dei sono nel alla si come più ma anche perché quando prima poi questo abbiamo senza dopo",
    "pt": "o os as um uma e é de que não por com para do da em no na se como mais mas também quando antes depois são foi sem este porque você",
    "nl": "de het een en is van dat niet op te met voor zijn er aan als maar ook bij wordt werd naar wij hebben voordat omdat kan moet zonder dan deze",
}
_SPEAKS: dict[str, list[str]] = {}
for _lang, _small in SMALL_WORDS.items():
    for _w in set(_small.split()):
        _SPEAKS.setdefault(_w, []).append(_lang)
#: Letters that speak for a language.
LETTERS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "éèêàçùîôœ", "it": "èìòù", "pt": "ãõçáêô", "nl": "ĳ"}
_SCRIPTS = (("zh", re.compile(r"[㐀-鿿]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("he", re.compile(r"[֐-׿]")), ("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")))
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f\u2000-\u206f]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|https?://\S+|\S+@\S+", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

#: How languages are called when a text asks for one.
NAMES = {
    "en": "english englisch anglais inglés английский английском 英语 英文",
    "de": "german deutsch allemand alemán немецкий немецком 德语",
    "fr": "french französisch français francés французский французском 法语",
    "es": "spanish spanisch espagnol español испанский испанском 西班牙语",
    "ru": "russian russisch russe ruso русский русском 俄语",
    "zh": "chinese chinesisch chinois chino китайский китайском 中文 汉语",
    "it": "italian italienisch italien italiano итальянский 意大利语",
    "pt": "portuguese portugiesisch portugais portugués португальский 葡萄牙语",
    "nl": "dutch niederländisch néerlandais neerlandés голландский 荷兰语",
    "ja": "japanese japanisch japonais japonés японский 日语",
}
_ASKED = re.compile("|".join(rf"(?P<{lang}>{'|'.join(names.split())})" for lang, names in NAMES.items()), re.I)


def language(text: str) -> str | None:
    """A language code, or None where the text says too little to tell."""
    if "`" in text or "@" in text or "://" in text:
        text = _CODE.sub(" ", text)
    if _BEYOND_LATIN.search(text):
        latin = len(_LATIN.findall(text))
        counts = {lang: len(pattern.findall(text)) for lang, pattern in _SCRIPTS}
        lang, n = max(counts.items(), key=lambda x: x[1])
        if counts["ja"] * 5 > counts["zh"] + counts["ja"] > 0:
            lang, n = "ja", counts["ja"] + counts["zh"]
        dense = 2.5 if lang in ("zh", "ja", "ko") else 1
        if n >= 3 and n * dense > latin:
            return lang
    lowered = text.lower().replace("’", "'")
    words = _WORD.findall(lowered)
    if sum(map(len, words)) < 8:
        return None
    score = dict.fromkeys(SMALL_WORDS, 0.0)
    for w in words:
        for k in _SPEAKS.get(w, ()):
            score[k] += 1
    if not text.isascii():
        for k, letters in LETTERS.items():
            score[k] += 0.5 * min(4, sum(map(lowered.count, letters)))
    order = sorted(score.items(), key=lambda x: -x[1])
    if order[0][1] < 2 or order[0][1] < 1.25 * order[1][1]:
        return None
    return order[0][0]


def languages_asked(text: str) -> set[str]:
    """The languages a text names, as in a wish for a translation or an answer in one of them."""
    return {m.lastgroup for m in _ASKED.finditer(text)}
