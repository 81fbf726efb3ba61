"""The tagger on sentences that share no template, name, street or number with the table it was trained on."""

import re

from gristmill.llm import pii

#: Written by hand as ordinary letters, mails and notices; items between [[kind: and ]].
TEXTS = """
Hi Tom, could you forward this to [[name:Rajesh Patel]]? His new address is [[email:rajesh.patel@gmail.com]] and his desk phone is [[phone:+44 161 496 0715]].
[[name:Priya Natarajan]] will chair the panel on Tuesday; [[name:Kenji Watanabe]] takes the notes.
The couple rents a flat at [[address:45 Elm Drive, Springfield 62704]] and has two cats.
If nobody answers at reception, dial [[phone:(312) 867-5309]] and ask for [[name:Ms. Thornbury]].
My social security number is [[id_number:219-09-9999]], please keep it safe.
We visited [[name:Fernando Gutiérrez]] in his workshop near [[address:calle Alcalá 7, 28014 Madrid]].
Passport number [[id_number:C4J7T9812]] expires in June.
Delivery note 4471 lists 12 boxes, 3 pallets and one crate for the Hartwell Museum.
The router at 10.20.30.40 was replaced by model KX-2204 in 2019.
Please reply to [[email:o.brennan@trinity-lodge.ie]], not to the old mailbox.
[[name:Dr. Abernathy]] saw nine patients before lunch.
Invoice 2023-00871 from Oakridge Ltd. was paid on 14 March.
According to [[name:Siobhan O’Malley]], the bridge closes at 18:30 each Sunday.
Ship everything to [[name:Mrs. Eleanor Whitcombe]], [[address:19 Harbour Street, Whitstable CT5 1AB]].
Version 3.12.4 fixed 17 bugs and needs port 8443.
Sehr geehrte Frau Bürgermeisterin, gestern rief [[name:Torben Steinkamp]] aus Kiel an.
Meine neue Handynummer lautet [[phone:0176 4455 6677]].
Der Lieferwagen stand vor der [[address:Rosenheimer Straße 12, 81669 München]].
Den Vertrag hat [[name:Frau Dr. Hildebrandt]] am Freitag geprüft.
Die Steuer-ID [[id_number:47 036 892 816]] steht auf dem Bescheid.
Schicken Sie die Fotos an [[email:fotos.kramer@web.de]] oder rufen Sie [[phone:+49 40 6688990]] an.
Im Lager 4 fehlen 37 Schrauben der Größe M8, Charge 550 120 337.
Das Museum Waldhof zeigt bis Mai 120 Bilder aus dem Jahr 1890.
[[name:Mme Fournier]] viendra jeudi avec [[name:Baptiste Lemoine]].
Son portable est le [[phone:06 71 82 93 04]], appelez avant midi.
Le camion est resté devant le [[address:27 rue des Lilas, 69003 Lyon]].
Écrivez-moi à [[email:c.dubreuil@orange.fr]] pour recevoir le plan.
La carte d’identité [[id_number:880692310285]] est périmée depuis mai.
Le train 8421 part à 9:05 du quai 3.
[[name:Don Aurelio Pacheco]] vendió la finca a [[name:Maribel Quintana]].
El fontanero vive en [[address:avenida de Portugal 88, 37005 Salamanca]].
Mi DNI es [[id_number:45678912-K]] y mi correo es [[email:lquintana88@hotmail.com]].
Llámame al [[phone:612 345 789]] cuando llegues.
El museo compró 45 cuadros en 1987 por 3200 €.
Ieri [[name:Ludovica Marchetti]] ha incontrato l’[[name:Avv. Sartori]] in tribunale.
L’officina si trova in [[address:via Cavour 31, 50129 Firenze]].
Il mio cellulare è [[phone:347 5512 880]].
Il codice fiscale [[id_number:MRCLDV84C52D612X]] è sul modulo.
A professora [[name:Graça Mendonça]] mora na [[address:Rua das Oliveiras 14, 4050-449 Porto]].
O meu NIF é [[id_number:231 456 789]], obrigado.
Fale com [[name:Eng. Sampaio]] pelo [[phone:+351 912 334 556]].
O livro tem 312 páginas e custa 18 €.
"""


def _read(line):
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[\[(\w+):(.*?)\]\]", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def measured():
    rows = [_read(x) for x in TEXTS.strip().split("\n")]
    found = pii.find([t for t, _ in rows])
    both = sum(len(set(a) & set(b)) for (_, a), b in zip(rows, found))
    return both, sum(len(a) for _, a in rows), sum(map(len, found)), [(t, sorted(set(a) ^ set(b))) for (t, a), b in zip(rows, found) if set(a) != set(b)]


def test_other_text():
    both, wanted, got, wrong = measured()
    assert both / wanted >= 0.8 and both / got >= 0.95, wrong  # 0.826 and 0.974 when this was written
