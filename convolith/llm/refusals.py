"""Refusals, by aligning each sentence of a reply with short frames.

A frame is a sequence of roles - who speaks, ability, negation, answering, declining, what is out of
bounds - not a sentence.  A sentence is turned into the roles its words can play; the longest common
subsequence with a frame has to be the whole frame, with gaps of any length, and the words that play no
role may only be small ones, a few others, or words of the request itself.  No wording is listed whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from convolith.llm.language import SMALL_WORDS

#: Words by the role they can play, in the languages the frames are read in; ``*`` stands for any ending.
ROLES = {
    "self": "m'est m'a estoy tengo tenho posso puedo debo devo quiero deseo lamento prefiero soy sono ho abbiamo siamo podemos temos possiamo estou queremos могу хочу должен вынужден mis mes ma notre nos mijn ons onze наш* мой мои моим моих meus minha miei mia nostr* nuestr* nosotras i i'm i've i'll i'd im we we're our me my mine myself us assistant ai model chatbot bot ich wir mir mich uns mein* unser* je j'ai nous moi mon yo me nosotros mi io noi mi eu nós ik wij mij я мы мне нам меня 我 我们 本人 私",
    "you": "you you'll you'd your du sie ihnen dir ihr vous votre tu te usted ustedes você u je jij вы вам вас ты тебе 你 您",
    "able": "direito derecho droit diritto diritti права право 权 权限 权力 choose* chose opt entitled equipped desir* deseo deseamos vermag préfer* préfèr* wünsch* imstande lage recht вправе готов* намерен* dispost* dispuest* bevoegd gemachtigd hábil prêt habilité* habilitad* can could may might should would will able ability allow* permi* authori* position liberty comfort* willing want* wish* rather prefer* going intend* free feasible possible appropriate proper acceptable right suitable kann können könnte* darf dürfen möchte* will wollen würde* erlaub* befugt gestattet bereit möglich peux puis peut pouvons pourrai* voudrai* souhait* veux préfér* possible autoris* capable puedo puede podemos podré podría quiero querer* prefiero autoriz* capaz posible posso possiamo possibile voglio consent* preferisco devo possível quero prefiro kan kunnen mag mogen wil toegestaan могу можем может могли мог возможно разреш* позвол* хочу хотел* предпо* 能 能够 可以 可 想 愿意 允许 方便",
    "not": "without not no nor nope never none nothing nobody neither don't doesn't didn't isn't aren't haven't nicht kein* nichts nie ne n pas aucun* jamais rien non no ningun* nada tampoco nunca nessun* não nem niet geen не нет нельзя ни никак 不 没 没有 别",
    "unable": "unanswered unanswerable unavailable 帮不上忙 帮不了 答不了 做不到 办不到 no-go disallow* barred verbiet* hinder* interdi* impide* impid* prohíb* vieta* impedi* proíb* verhinder* мешает 禁止 不得 不宜 难以 can't cannot cant couldn't won't wouldn't mayn't unable incapable impossible inappropriate unwilling uncomfortable forbid* prohibit* prevent* verwehrt untersagt verboten unmöglich außerstande impossible incapable interdit* imposible prohibido impossibile impossível verboden невозможно запрещ* 无法 不能 不可以 不便 不会 不想 不愿 未能",
    "answer": "接受 支持 答应 效劳 指导 elaborat* opin* weigh speech sprech* rede* diskutier* kommentier* preisgeben verraten informier* evaluat* review tratar trat* revel* divulg* comenta* commenta* обсуд* объясн* комментир* подсказ* bespreken delen dienen orientar trata* révél* communiqu* conseil* aconsej* consigli* berat* rat 建议 解释 告诉 谈 聊 讲 help* assist* aid answer* respon* repl* discuss* provid* suppl* share sharing shared disclos* reveal* comment* fulfil* compl* accommodat* entertain grant* give given giving tell talk* speak* say support* engag* address* touch* handl* assess advis* advice information info details opinion offer* serve process* contribut* explain* generat* produc* beantwort* antwort* auskunft auskünfte helfen hilf* weiterhelf* behilflich unterstütz* sagen geben äußer* nennen bearbeit* entsprech* erfüll* eingehen liefern répon* repon* aider aide fournir donner traiter dire parler partager satisfaire accéder discuter ayud* respond* contest* proporcion* dar dec* hablar compart* atend* cumplir facilitar comentar aiut* rispond* fornir* dare dire parlar* condivid* soddisf* ajud* respond* fornec* falar compartilhar helpen beantwoord* antwoord* geven verstrekken ingaan помо* отвеча* ответ* предостав* обсужд* сказать говорить рассказ* выполн* дать комментир* поделиться 回答 回复 帮助 帮忙 帮 协助 提供 处理 满足 讨论 答复 解答 说明 评论 透露 谈论",
    "do": "do does done doing go tun machen faire hacer hacerlo fare farlo fazer doen сделать делать 做",
    "decline": "negat* denied deny dismiss* withhold* avoid* passe* skip abschlagen zurückweis* absehen esquiv* abstenho abstien* evit* onthoud* уклон* 回避 declin* pass refus* reject* abstain* refrain* ablehn* lehne verweiger* verzicht* refuse* déclin* declin* rechaz* negar* niego abstener* rifiut* declino recus* weiger* afwijz* отказ* отклон* воздерж* 拒绝 婉拒 谢绝",
    "outside": "overschrijd* exced* excèd* super* ecced* überschreit* sprengt transgress* conflict* contrair* contrari* ausgeschlossen tabu taboo прочь противореч* выходит пределы 不符合 有违 outside beyond against violat* contraven* breach* limits off-limits contra contre gegen verstößt verstoss* außerhalb jenseits hors dépass* fuera viola infring* fuori contro fora buiten tegen против вне нарушает 超出 违反 违背",
    "rule": "norm* standard* ethic* instruction* charter code ethik leitlinie* grundsätz* éthique charte ética limiti limiet инструкц* принцип* 守则 规范 指南 polic* guideline* rule rules terms safety principles scope remit boundar* regulations capabilit* richtlinie* regeln vorgaben rahmen règles directives politique* consignes cadre política* normas directrices reglas alcance regole linee politiche regras diretrizes beleid richtlijnen regels правил* политик* рамк* 政策 规定 准则 范围 规则 原则",
    "request": "topics subjects one's anliegen ersuchen sachverhalt punkt point asunto cuestión materia questão matéria kwestie сообщен* предмет* 事 事情 问 内容 request* question* quer* topic subject matter inquir* ask asked task prompt demand one kind sort type thing anfrage* frage* thema bitte* wunsch demande* question* requête* sujet solicitud* pregunta* petición tema consulta richiesta domanda argomento pedido pergunta assunto verzoek vraag onderwerp запрос* вопрос* просьб* тем* 请求 问题 要求 话题 主题",
    "sorry": "spiac* entristec* verzeih* pesar lástima pena désolation jammer sorry apolog* regret* unfortunate* afraid pardon sadly leider leid bedau* entschuld* désolé* desolé* malheureusement regrett* excus* siento lament* desgracia* disculp* perdón dispiace purtroppo scus* desculp* infelizmente lamento helaas spijt* sorry извин* прост* жаль сожалению увы 抱歉 对不起 遗憾 不好意思 很遗憾",
    "else": "else another other others different anything something sonst ander* weitere* autre* chose otra* otro* altr* outr* anders ander* друго* другой друг* ещё еще 其他 别的 另外 还有",
    "thanks": "thank* understand* understood patience hope glad happy feel welcome verständnis verstehen hoffe gerne dank* merci compr* volontiers gracias entend* grazie capi* obrigad* dank begrip спасибо понима* понять надеюсь рад 谢谢 感谢 理解 谅解 希望",
}
#: Words that add nothing to what a refusal says, beside the small words of the languages.
NEUTRAL = frozenset("leave made put take taken get got ask asks asked way anyone anybody whatever none's bin habe hat hast sein wäre kann's suis es ai avons est sera mesure en estoy estamos soy he hemos condiciones condición tenho temos tem estou sou ho abbiamo sono ben heb het имею имеем есть буду будем сейчас об о про 非常 十分 实在 真的 很抱歉 感到 told been werde wird darüber daran hierüber davon va vas es il c'est ce sont uit over daar daarop hierop su sus sulla proprio tout todo algo alguno dies diesbezüglich cet égard respecto riguardo насчёт поводу must think believe out those these respectfully politely kindly matters hierzu dafür hierauf have has having need needs happen* please must've quite really simply just still currently here there today further such so be being been for any sort reasons reason due because language large as that's it's which what who where whether cause like know let free feel instead directly hereby honestly frankly muss müssen sollte dazu darauf dabei damit diese diesem dieser dieses solche solch etwas gern hier leider auch dois doit devons cela ça ceci cette cet ces tel telle ici d' l' y à debo tengo que esto eso esta ese esa tal aquí por ahora sobre con qui questo questa quello essere dever isso esta este deze dit dat moet hier это этот этом этого эту этой эти таком такие такой данн* должен должна вынужден* придётся придется приходится здесь с на в по с чем то ли 这 这个 那 那个 此 该 类 种 些 吗 的 了 是 只 只能 必须 得 很 请 有 对 给 向 于 为 什 么 什么 与 和 关 关于 作为 一个 人工智能 我的 您的 这样 还".split())
_SMALL = frozenset(w for words in SMALL_WORDS.values() for w in words.split())
#: What follows these gives a reason or a condition, and then says something.
REASONS = frozenset("because until unless while when since once after before weil solange wenn bis nachdem bevor sobald parce puisque tant quand lorsque porque cuando mientras hasta perché quando finché omdat wanneer totdat если потому пока когда после 因为 除非 如果 直到".split())

_TOKEN = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+(?:['’-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|(?<=[。！？])|\n+")
SLACK = 0.25  # most words of a sentence that play no role, as a share


def tokens(text: str) -> list[str]:
    return [t.casefold().replace("’", "'") for t in _TOKEN.findall(text)]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: whole texts, no cut."""
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        m = row & at.get(t, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def sentences(text: str) -> Iterator[str]:
    at = 0
    for end in _SENTENCE.finditer(text):
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


def _lexicon() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    exact: dict[str, list[str]] = {}
    stems: dict[str, list[str]] = {}
    for role, words in ROLES.items():
        for w in words.split():
            to, key = (stems, w[:-1]) if w.endswith("*") else (exact, w)
            got = to.setdefault(key.casefold(), [])
            got += [role] if role not in got else []
    for w in NEUTRAL:
        to, key = (stems, w[:-1]) if w.endswith("*") else (exact, w)
        to.setdefault(key.casefold(), [])
    return exact, stems


_EXACT, _STEMS = _lexicon()
_HAN = max(len(w) for w in _EXACT if "㐀" <= w[0] <= "鿿")
_STEM_LENGTHS = sorted({len(s) for s in _STEMS}, reverse=True)


@lru_cache(maxsize=1 << 16)
def _roles(word: str) -> list[str] | None:
    """The roles a word can play; an empty list for words that add nothing, None for all others."""
    got = _EXACT.get(word)
    if got is not None:
        return got
    if word in _SMALL:
        return []
    for n in _STEM_LENGTHS:
        if n < len(word) and (got := _STEMS.get(word[:n])) is not None:
            return got
        if n == len(word) and (got := _STEMS.get(word)) is not None:
            return got
    head = re.split(r"['-]", word)
    if len(head) > 1:
        parts = [_roles(h) for h in head if h]
        if all(p is not None for p in parts):
            return [r for p in parts for r in p or []]
    return None


def _words(sentence: str) -> list[str]:
    """Tokens, characters of Chinese joined to the longest words the lexicon knows."""
    flat, out, i = tokens(sentence), [], 0
    while i < len(flat):
        if "㐀" <= flat[i] <= "鿿":
            for n in range(_HAN, 0, -1):
                if (w := "".join(flat[i : i + n])) in _EXACT or n == 1:
                    out.append(w)
                    i += min(n, len(flat) - i)
                    break
        else:
            out.append(flat[i])
            i += 1
    return out


_REFUSAL = (
    [list(p) for p in itertools.permutations(("able", "not", "answer"))]
    + [["unable", "answer"], ["answer", "unable"]]
    + [["self", *p] for p in itertools.permutations(("able", "not", "do"))]
    + [["self", "unable", "do"], ["do", "self", "unable"]]
    + [["self", "decline"], ["decline", "self"], ["request", "decline"], ["decline", "request"], ["decline", "answer"]]
    + [["outside", x] for x in ("rule", "able", "answer", "self")]
    + [["request", "outside"], ["rule", "outside"], ["rule", "not", "able"], ["not", "able", "rule"]]
    + [["sorry", "not", "answer"], ["sorry", "answer", "not"]]
)
#: Frames that hold only where no word is left over, or one beside a first person that does not answer.
_BARE = [["sorry", "unable"], ["self", "unable"], ["request", "unable"], ["unable", "request"], ["self", "not", "answer"], ["not", "self", "answer"], ["self", "answer", "not"], ["answer", "self", "not"]]
_NO_ANSWER = _BARE[4:]
_COURTESY = [["else", x] for x in ("answer", "request", "you", "self")] + [[x, "else"] for x in ("answer", "request", "able", "you")] + [["sorry"], ["thanks"], ["able", "self", "answer"], ["self", "able", "answer"], ["you", "request"]]


def _aligns(frames: list[list[str]], played: list[str]) -> bool:
    have = set(played)
    return any(have.issuperset(f) and lcs_length(f, played) == len(f) for f in frames)


def kind(sentence: str, request: frozenset[str] = frozenset()) -> str | None:
    """'refusal' or 'courtesy' if the sentence follows a frame and says nothing else.

    ``request`` are the words of what was asked for; repeating them says nothing new.
    """
    words = _words(sentence)
    if not words:
        return None
    said = [_roles(w) for w in words]
    played = [r for got in said for r in got or ()]
    if not played:
        return None
    new = [w for w, got in zip(words, said, strict=True) if got is None and w not in request]
    strange = [w for w, got in zip(words, said, strict=True) if got is None]
    personal = {"self", "sorry"} & set(played)
    if any(any(map(str.isdigit, w)) for w in new) or len(new if personal else strange) > SLACK * len(words):
        return None
    spoken = personal or {"request", "rule"} & set(played)
    for i, w in enumerate(words):
        if w in REASONS and any(x is None for x in said[i + 1 :]):
            return None  # a reason or condition that names things
        if i and "you" in (said[i - 1] or ()) and "self" not in (said[i - 1] or ()) and {"able", "unable"} & set(said[i] or ()) and not personal:
            return None  # somebody else can't
    if (spoken or not strange) and _aligns(_REFUSAL, played) or not strange and _aligns(_BARE, played) or len(strange) == 1 and _aligns(_NO_ANSWER, played):
        return "refusal"
    return "courtesy" if not strange and _aligns(_COURTESY, played) else None


def may_refuse(words: list[str]) -> bool:
    """A word that can decline is among ``words``: no frame is without one."""
    roles = {r for w in set(words) for r in _roles(w) or ()}
    return bool(roles & {"unable", "decline", "outside"}) or "not" in roles and bool(roles & {"able", "sorry", "answer"}) or any("㐀" <= w[0] <= "鿿" for w in words)


def is_refusal(prompt: str, reply: str, aside: Callable[[str], bool]) -> bool:
    """At least one sentence declines, and none says anything else.

    ``aside`` tells sentences that answer nothing, such as contact details.  The scan ends at the
    first sentence that says something, so replies of any length are read as far as they matter.
    """
    refuses, request = False, None
    for sentence in sentences(reply):
        if not _TOKEN.search(sentence):
            continue
        if request is None:
            request = frozenset(tokens(prompt))
        got = kind(sentence, request)
        if got is None and not aside(sentence):
            return False
        refuses = refuses or got == "refusal"
    return refuses
