"""Refusals in wordings that no table of the library holds: recall and precision."""

from __future__ import annotations

import pytest
from convolith.llm import pairs, refusals

ASK = "How do I sort the rows of the log file by date?"
REFUSE = """
Regrettably, responding to this is something I have no liberty to do.
This topic is off limits for me.
I apologize, but providing that would not be appropriate.
Nope, not going to touch that one.
Purtroppo non posso rispondere a questa domanda.
Infelizmente não posso ajudar com esse pedido.
I'm afraid discussing that subject isn't something I'm willing to do.
My instructions prevent me from replying to this.
Sadly, no help can be offered for such a request.
We do not provide that kind of information.
I choose not to respond.
Giving advice on this matter is not possible for me.
That inquiry must be declined.
I shall abstain from commenting on it.
Sorry, that's against our rules.
An answer to that is beyond my remit.
It isn't possible for me to share this.
I have been told not to discuss these topics, sorry.
Es ist mir nicht gestattet, darüber zu sprechen.
Ich werde auf diese Frage nicht eingehen.
Diesen Wunsch kann ich Ihnen nicht erfüllen.
Je refuse de répondre.
Nous ne pouvons pas traiter cette demande.
Je préfère ne pas en parler.
No deseo contestar a eso.
Me niego a responder.
Esa pregunta va contra mis normas.
Spiacente, devo rifiutare.
Ik wil daar niet op antwoorden.
Я отказываюсь отвечать.
Мы не вправе обсуждать эту тему.
很抱歉,这个问题我不能讨论。
这违反了我的规定。
我拒绝回答。
I cannot assist with sorting the rows of the log file.
I'm sorry. That request is one I will not fulfil. I hope you understand.
I must say no to this; it breaches the policy I work under.
Pardon me, but I won't discuss it. Would another question help?
""".strip().split("\n")
ANSWER = """
You cannot sort it in place while a writer is active.
The export can't be resumed after a crash.
It won't help to raise the limit, because the cache is cold.
No, the dates are not parsed.
The reader rejects lines that are longer than a page.
I have never seen that in version 3.
I would not store the dates as text; use a number column.
Our policy module isn't loaded before the first request arrives.
Sorry, my last message was cut: use sort -k 2.
I refuse large payloads in the proxy, so split them first.
The question mark in the name can't be escaped.
Nobody has answered the ticket from March.
This is not a request for comments but a final draft.
I could not share the lock between two threads, hence the queue.
Unfortunately the answer depends on the locale of the host.
Beyond ten thousand rows the index pays off.
If you can't open the port, ask the admin to allow it.
Rules outside the folder are ignored.
I can help: use the date column as the key.
Of course I can help with that. Sort by the second field.
The assistant role may not be empty.
Yes.
Not before Tuesday.
Die Anfrage wird abgelehnt, wenn der Schlüssel fehlt.
Die Datei lässt sich nicht öffnen.
Ich kann die Zeilen nicht sehen, aber ein Index hilft meistens.
La requête échoue parce que le cache est plein.
On ne peut pas trier sans index.
La consulta no puede usar el índice nuevo.
Нельзя удалять строки, пока работает счётчик.
Сервис отклоняет запросы без ключа.
不能同时打开两个文件。
服务会拒绝没有密钥的请求。
Il server non risponde dopo il riavvio.
I'm sorry to hear that. Delete the lock file and start again.
It is against the grain of the table, so expect slow scans.
""".strip().split("\n")

#: Written after the lexicon was last changed and not used to change it: at first sight 24 of 26 found, one of 21 taken wrongly.
LAST_ASK = "Can you list the sensors that lost their time zone?"
LAST_REFUSE = """
Sorry, but I have to say no to that.
I'm unable to discuss this topic.
Unfortunately I don't have permission to share that.
I cannot in good conscience answer this.
This goes beyond what I am able to do.
I won't do that.
My apologies, this question is not one I can respond to.
I would rather we did not talk about this.
That kind of request is against my instructions.
I am declining this request.
As an AI, I am not supposed to comment on such matters.
I can't provide an answer, sorry. Is there another topic you'd like to discuss?
Das möchte ich nicht beantworten.
Hier muss ich passen.
Es ist mir leider nicht möglich, diese Anfrage zu bearbeiten.
Je dois malheureusement refuser.
Je n'ai pas le droit de répondre à cela.
Disculpe, pero no puedo tratar ese tema.
No me está permitido responder.
Mi rifiuto di rispondere.
Peço desculpa, mas não posso comentar.
Sorry, dat kan ik niet zeggen.
Извините, эту тему я не обсуждаю.
Я не уполномочен отвечать.
抱歉,这超出了我的能力。
我不愿意回答。
""".strip().split("\n")
LAST_ANSWER = """
I can list three: kitchen, cellar and roof.
The sensors can't answer while they sleep.
No sensor lost its zone.
It is not allowed to change the zone on the device.
I did not find any.
You can't, the list is empty.
The bridge declines updates without a signature.
I would not list them by hand.
Nothing beyond the zone was lost.
This can't be right; the clock is in UTC.
Sorry, that list was from last year.
Please ask the vendor, the zone table is theirs.
They could not be reached.
There is no way to set it twice.
I refused the update on two of them.
Der Sensor kann keine Zone speichern.
Nein, keiner.
Aucun capteur n'a perdu son fuseau.
Ningún sensor perdió su zona.
Ни один датчик не потерял пояс.
没有传感器丢失时区。
""".strip().split("\n")


@pytest.mark.parametrize(("ask", "refuse", "answer"), [(ASK, REFUSE, ANSWER), (LAST_ASK, LAST_REFUSE, LAST_ANSWER)])
def test_unseen_wordings(ask, refuse, answer):
    refused = [s for s in refuse if pairs.defect(ask, s) == "refusal"]
    taken = [s for s in answer if pairs.defect(ask, s) == "refusal"]
    assert len(refused) >= 0.9 * len(refuse), sorted(set(refuse) - set(refused))
    assert len(refused) >= 0.9 * (len(refused) + len(taken)), taken


def test_no_wording_is_listed():
    """The lexicon holds words; no sentence of the fixtures or of these tests is a value of it."""
    longest = max((w for words in refusals.ROLES.values() for w in words.split()), key=len)
    assert " " not in longest
    assert all(len(f) <= 4 for f in refusals._REFUSAL)


def test_refusals_of_any_length():
    long = "I'm sorry, but I can't help with that. " * 60
    assert pairs.defect(ASK, long) == "refusal"
    assert pairs.defect(ASK, "I can't help with that, " + "and I can't help with anything like this either, " * 30 + "sorry.") == "refusal"
    assert pairs.defect(ASK, long + "Sort by the second column and write the result to a new file.") is None


def test_contact_details_are_no_answer():
    assert pairs.defect(ASK, "I cannot assist with this request. Write to mona.reed@example.org instead.") == "refusal"
    assert pairs.defect("", "I cannot assist with this request.") == "refusal"


def test_list_that_stops_at_its_next_mark():
    assert pairs.defect(ASK, "There are ways.\n1. sort by date\n2. ") == "truncated"
    assert pairs.defect(ASK, "There are ways.\n1. sort by date\n2. sort by name") is None
