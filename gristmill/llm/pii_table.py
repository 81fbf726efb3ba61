"""The labelled table from which the tagger of personal information is trained.

Lines are written by hand with the labels in place: ``{name}``, ``{email}``, ``{phone}``,
``{id_number}`` and ``{address}`` stand where an item of that kind stands, ``<code>`` and the
like where a look-alike does. ``labelled`` fills the places with invented values and gives
(text, [(start, end, kind)]). Between the lines stand runs of usual words of the language, with
and without items, so that no turn of phrase is needed to know one. Values are made up here from
word lists and syllables; none belongs to a person.
"""

from __future__ import annotations

import random
import re
import unicodedata

from gristmill.llm.language import COMMON

LINES = {
    "en": """{name} signed the lease yesterday.
This was approved by {name} and {name}.
Contact: {name}, {phone}
You may write to {email} or ring {phone}.
My number is {phone}, ask for {name}.
{name} lives at {address}.
We moved from {address} to {address}.
Deliver it to {name}, {address}, before noon.
Her passport number is {id_number}.
SSN {id_number} was typed by hand.
The holder of {id_number} is {name}.
{name} ({email}) wrote this.
Mail {email}; phone {phone}.
From: {name} <{email}>
To: {email}, {email}
Tel {phone} / Mobile {phone}
Address {address}
Tax number {id_number}, name {name}
Yours, {name}
Best wishes¶{name}¶{email}¶{phone}
Regards¶{name}¶{address}
Name: {name}¶Address: {address}¶Phone: {phone}
Email: {email}¶ID: {id_number}
Passport: {id_number}¶Mobile: {phone}
A parcel came for {name} at {address}; call {phone}.
{id_number} is the number on the card of {name}.
Ask {name} or {name} about it.
Yesterday {name} and {name} met the landlord at {address}.
Fax {phone}, attention of {name}.
The house at {address} was sold.
Emergency contact {phone}.
Login of <brand> failed <n> times.
Invoice <code> of <brand> Ltd. lists <n> items for <n> €.
Order <code> left <brand> House on <date>.
The <brand> & Sons catalogue has number <grp9>.
<brand> Inc. sold <n> units in <year>.
Serial <model>, checksum <grp>.
Host <ip>, port <n>, version <ver>.
See https://<low>.example/<low>?id=<n> and page <n>.
Lot <grp9>, shelf <n>, room <n>, <brand> Hall.
The <brand> <brand> Review, volume <n>, <year>-<year>.
Between <time> and <time> the <brand> server ran <n> jobs.
@<low> posted <n> times under #<low>.
The <brand> Bridge and the <brand> Library reopened in <year>.
Batch <grp9> weighs <n> kg; ticket <code> is closed.
Reference <grp>, model <model>, <n> pages.""",
    "de": """{name} hat den Mietvertrag unterschrieben.
Genehmigt von {name} und {name}.
Ansprechpartner: {name}, {phone}
Schreiben Sie an {email} oder rufen Sie {phone} an.
Meine Nummer ist {phone}, fragen Sie nach {name}.
{name} wohnt in {address}.
Wir sind von {address} nach {address} gezogen.
Liefern Sie es vor zwölf an {name}, {address}.
Ihre Passnummer lautet {id_number}.
Die Nummer {id_number} steht auf dem Ausweis von {name}.
Die Steuernummer {id_number} fehlt noch.
{name} ({email}) hat das geschrieben.
Von: {name} <{email}>
An: {email}, {email}
Tel. {phone} / Mobil {phone}
Wohnort {address}
Viele Grüße, {name}
Herzliche Grüße¶{name}¶{email}¶{phone}
Beste Grüße¶{name}¶{address}
Name: {name}¶Adresse: {address}¶Tel.: {phone}
E-Mail: {email}¶Ausweis: {id_number}
Pass: {id_number}¶Handy: {phone}
Ein Brief kam für {name} in die {address}; Rückruf {phone}.
Fragen Sie {name} oder {name}.
Gestern trafen {name} und {name} den Makler vor {address}.
Fax {phone}, zu Händen {name}.
Das Haus {address} wurde verkauft.
Im Notfall {phone} wählen.
Die Rechnung <code> der <brand> GmbH nennt <n> Posten zu <n> €.
Der Auftrag <code> verließ das <brand> Haus am <date>.
Seriennummer <model>, Prüfwert <grp>.
Rechner <ip>, Port <n>, Stand <ver>.
Siehe https://<low>.example/<low>?id=<n> und Seite <n>.
Posten <grp9>, Regal <n>, Raum <n>, <brand> Halle.
Zwischen <time> und <time> Uhr liefen bei <brand> <n> Aufträge.
@<low> schrieb <n> Mal unter #<low>.
Die <brand> Brücke und die <brand> Bibliothek öffneten <year>.
Charge <grp9> wiegt <n> kg; Vorgang <code> ist erledigt.
Der Band <n> der <brand> Zeitschrift, <year>-<year>.""",
    "fr": """{name} a signé le bail hier.
Approuvé par {name} et {name}.
Contact : {name}, {phone}
Écrivez à {email} ou téléphonez au {phone}.
Mon numéro est le {phone}, demandez {name}.
{name} demeure {address}.
Nous avons quitté {address} pour {address}.
Livrez-le à {name}, {address}, avant midi.
Son numéro de passeport est {id_number}.
Le numéro {id_number} figure sur la carte de {name}.
Numéro fiscal {id_number}, nom {name}
{name} ({email}) a écrit ceci.
De : {name} <{email}>
À : {email}, {email}
Tél. {phone} / Portable {phone}
Domicile {address}
Bien à vous, {name}
Salutations¶{name}¶{email}¶{phone}
Amicalement¶{name}¶{address}
Nom : {name}¶Adresse : {address}¶Téléphone : {phone}
Mél : {email}¶Identité : {id_number}
Passeport : {id_number}¶Mobile : {phone}
Une lettre est venue pour {name} au {address} ; rappel au {phone}.
Demandez à {name} ou à {name}.
Hier {name} et {name} ont vu l’agent devant le {address}.
La maison du {address} est vendue.
En cas d’urgence composez le {phone}.
La facture <code> de <brand> SARL compte <n> lignes à <n> €.
La commande <code> a quitté la Maison <brand> le <date>.
Série <model>, somme <grp>.
Machine <ip>, port <n>, version <ver>.
Voir https://<low>.example/<low>?id=<n> et la page <n>.
Lot <grp9>, étagère <n>, salle <n>, Hall <brand>.
Entre <time> et <time> le serveur <brand> a fait <n> tâches.
@<low> a écrit <n> fois sous #<low>.
Le Pont <brand> et la Bibliothèque <brand> ont rouvert en <year>.
Le volume <n> de la Revue <brand>, <year>-<year>.""",
    "es": """{name} firmó ayer el alquiler.
Aprobado por {name} y {name}.
Contacto: {name}, {phone}
Escriba a {email} o marque el {phone}.
Mi número es el {phone}, pregunte por {name}.
{name} reside en {address}.
Nos mudamos de {address} a {address}.
Entréguelo a {name}, {address}, antes del mediodía.
Su número de pasaporte es {id_number}.
El número {id_number} consta en la tarjeta de {name}.
Número fiscal {id_number}, nombre {name}
{name} ({email}) escribió esto.
De: {name} <{email}>
Para: {email}, {email}
Tel. {phone} / Móvil {phone}
Dirección {address}
Saludos, {name}
Atentamente¶{name}¶{email}¶{phone}
Un abrazo¶{name}¶{address}
Nombre: {name}¶Dirección: {address}¶Tel.: {phone}
Correo electrónico: {email}¶NIE: {id_number}
Pasaporte: {id_number}¶Móvil: {phone}
Llegó una carta para {name} a {address}; avise al {phone}.
Pregunte a {name} o a {name}.
Ayer {name} y {name} vieron la casa de {address}.
En caso de urgencia marque {phone}.
La factura <code> de <brand> S.L. suma <n> líneas por <n> €.
El pedido <code> salió de la Casa <brand> el <date>.
Serie <model>, suma <grp>.
Equipo <ip>, puerto <n>, versión <ver>.
Véase https://<low>.example/<low>?id=<n> y la página <n>.
Lote <grp9>, estante <n>, sala <n>, Nave <brand>.
Entre las <time> y las <time> el servidor <brand> hizo <n> tareas.
@<low> escribió <n> veces en #<low>.
El Puente <brand> y la Biblioteca <brand> reabrieron en <year>.
El tomo <n> de la Revista <brand>, <year>-<year>.""",
    "it": """{name} ha firmato ieri il contratto.
Approvato da {name} e {name}.
Contatto: {name}, {phone}
Scrivete a {email} o telefonate al {phone}.
Il mio numero è {phone}, chiedete di {name}.
{name} vive in {address}.
Ci siamo trasferiti da {address} a {address}.
Consegnatelo a {name}, {address}, prima di mezzogiorno.
Il suo numero di passaporto è {id_number}.
Il numero {id_number} è sulla tessera di {name}.
C.F. {id_number}, nome {name}
{name} ({email}) lo ha scritto.
Da: {name} <{email}>
A: {email}, {email}
Tel. {phone} / Cell. {phone}
Residenza {address}
Un saluto, {name}
Distinti saluti¶{name}¶{email}¶{phone}
A presto¶{name}¶{address}
Nome: {name}¶Indirizzo: {address}¶Tel.: {phone}
E-mail: {email}¶C.F.: {id_number}
Passaporto: {id_number}¶Cellulare: {phone}
Una lettera è arrivata per {name} in {address}; richiamare {phone}.
Chiedete a {name} o a {name}.
Ieri {name} e {name} hanno visto la casa di {address}.
In caso di urgenza comporre {phone}.
La fattura <code> di <brand> S.p.A. ha <n> righe per <n> €.
L’ordine <code> ha lasciato Casa <brand> il <date>.
Serie <model>, somma <grp>.
Macchina <ip>, porta <n>, versione <ver>.
Vedi https://<low>.example/<low>?id=<n> e pagina <n>.
Lotto <grp9>, scaffale <n>, sala <n>, Padiglione <brand>.
Tra le <time> e le <time> il server <brand> ha svolto <n> compiti.
@<low> ha scritto <n> volte in #<low>.
Il Ponte <brand> e la Biblioteca <brand> hanno riaperto nel <year>.
Il volume <n> della Rivista <brand>, <year>-<year>.""",
    "pt": """{name} assinou ontem o contrato.
Aprovado por {name} e {name}.
Contacto: {name}, {phone}
Escreva para {email} ou telefone para {phone}.
O meu número é {phone}, pergunte por {name}.
{name} vive em {address}.
Mudámos de {address} para {address}.
Entregue a {name}, {address}, antes do meio-dia.
O número do passaporte é {id_number}.
O número {id_number} está no cartão de {name}.
Contribuinte {id_number}, nome {name}
{name} ({email}) escreveu isto.
De: {name} <{email}>
Para: {email}, {email}
Tel. {phone} / Telemóvel {phone}
Residência {address}
Cumprimentos, {name}
Atenciosamente¶{name}¶{email}¶{phone}
Um abraço¶{name}¶{address}
Nome: {name}¶Endereço: {address}¶Tel.: {phone}
E-mail: {email}¶Contribuinte: {id_number}
Passaporte: {id_number}¶Telemóvel: {phone}
Chegou uma carta para {name} em {address}; avise pelo {phone}.
Pergunte a {name} ou a {name}.
Ontem {name} e {name} viram a casa de {address}.
Em caso de urgência marque {phone}.
A fatura <code> da <brand> Lda. soma <n> linhas por <n> €.
A encomenda <code> saiu da Casa <brand> em <date>.
Série <model>, soma <grp>.
Máquina <ip>, porta <n>, versão <ver>.
Ver https://<low>.example/<low>?id=<n> e a página <n>.
Lote <grp9>, estante <n>, sala <n>, Pavilhão <brand>.
Entre as <time> e as <time> o servidor <brand> fez <n> tarefas.
@<low> escreveu <n> vezes em #<low>.
A Ponte <brand> e a Biblioteca <brand> reabriram em <year>.
O volume <n> da Revista <brand>, <year>-<year>.""",
}

#: What may stand before an item, and before a look-alike, in a run of usual words: the item's kind in each language.
BEFORE = {
    "email": "e-mail|mail|email|courriel|correo|posta|correio|mailto:|at|an|à|a|para|unter|by mail to|E-Mail:|Email:",
    "phone": "call|phone|tel|Tel.|mobile|dial|ring|on|fax|rufen|Telefon|unter|anrufen|Handy|über|téléphone|au|appeler|composer|portable|teléfono|al|en el|llamar|marcar|móvil|telefono|numero|chiamare|cellulare|telefone|pelo|ligar|telemóvel|+",
    "id_number": "ID number:|ID number –|ID number|insurance record|insurance number|personal number|document|card|nennt die Nummer|gave the number|passport|passport no.|social security number|national insurance|identity card|tax ID|ID|card no.|Reisepass|Reisepass Nr.|Personalausweis|Ausweisnummer|Steuer-ID|Sozialversicherungsnummer|passeport|passeport n°|sécurité sociale|numéro de sécurité sociale|carte d’identité|N° d’identité :|numéro fiscal|pasaporte|pasaporte n.º|DNI|NIE|documento de identidad|passaporto|passaporto n.|codice fiscale|carta d’identità|passaporte|passaporte n.º|NIF|cartão de cidadão|bilhete de identidade",
    "address": "lives at|at|to|in|of|from|in die|in der|wohnt in|nach|Anschrift|zur|au|du|habite|domicilié au|en|vive en|de|domicilio|in|abita in|di|residente in|em|mora em|morada|para|Address:|Anschrift:|Adresse :|Dirección:|Indirizzo:|Morada:",
    "name": "by|with|for|from|to|Dear|von|mit|für|an|Liebe|par|avec|pour|chez|por|con|para|da|di|com|c/o|z. Hd.|and|und|et|y|e|;|,|–|-",
}
LIKE = "checksum <grp>|batch <grp9>|lot <grp9>|catalogue no. <grp9>|invoice <code>|ticket <code>|order <code>|port <n>|page <n>|model <model>|room <n>|hall <n>|version <ver>|at <time>|<ip>|<year>-<year>|<n> pages|<n> percent|€ <n>|<n> €|<date>|Prüfsumme <grp>|Charge <grp9>|Lieferung <grp9>|Rechnung <code>|Anschluss <n>|Modell <model>|somme de contrôle <grp>|lot <grp9>|facture <code>|lote <grp9>|factura <code>|suma de control <grp>|partita <grp9>|fattura <code>|fatura <code>|série <grp9>|<brand>|<brand>|“<brand>”|« <brand> »|<brand> GmbH|<brand> & Sons|<brand> Ltd.|<brand> S.A.|<brand> Hall|<brand> Archive|<brand> Archiv|Centre <brand>|Centro <brand>|<brand> Field Notes|<brand> Reading Guide|<brand> Annual Report|@<low>|#<low>|/<low>/<low>.txt|https://<low>.example/<low>"


#: Given names and titles usual in each language, and given and family names of other regions.
GIVEN = {
    "en": "Emily Anna Thomas Karen Daniel George Helen Robert Peter Susan Martin Laura James Mary John Alice Henry Grace Oliver Ruth William Charlotte Jack Sarah Michael Elizabeth David Jessica Andrew Rachel Samuel Amy Edward Claire",
    "de": "Käthe Jürgen Ursula Stefan Sabine Claudia Andreas Jörg Monika Lukas Thomas Anna Peter Hans Heike Günter Birgit Max Wolfgang Petra Dieter Ingrid Uwe Silke Torsten Anke Felix Lena Björn Renate",
    "fr": "François Antoine Mathieu Béatrice Laurent Nicolas Sophie Camille Hélène Chloé Julien Élodie Thomas Jeanne Étienne Luc Pierre Marie Jean-Luc Anne-Sophie Olivier Céline Guillaume Aurélie Rémi Manon Benoît Inès",
    "es": "María Raúl Inés Álvaro Pilar Sergio Javier José Lucía Andrés Carmen Daniel Elena Luis Rocío Íñigo Antonio Isabel Manuel Teresa Pablo Cristina Diego Marta Rubén Nuria Joaquín Beatriz",
    "it": "Elena Marco Francesca Matteo Niccolò Paola Stefano Luca Chiara Giulia Martina Paolo Anna Franco Giovanni Silvia Alessandro Valentina Andrea Federica Roberto Sara Giorgio Ilaria Davide Laura",
    "pt": "Gonçalo Catarina Inês Duarte João Mariana Sofia Beatriz Rui Tiago Pedro Ana Luís Marta Miguel Teresa António Filipa Nuno Joana Ricardo Leonor Francisco Matilde Vasco Helena",
}
OTHERS = "Aisha Omar Fatima Yusuf Wei Ling Hiroshi Yuki Arjun Deepa Sanjay Anjali Olga Dmitri Katarzyna Piotr Zoltán Ilona Eirik Astrid Mehmet Elif Kwame Amara Thabo Nguyen Minh Priscila Thiago Ahmed Leila Ivan Milena".split()
FAMILY = "Smith Brown Taylor Evans Walker Hughes Clarke Müller Schneider Fischer Weber Becker Hoffmann Schäfer Krüger Dubois Moreau Lefèvre Girard Rousseau García Martínez López Hernández Ruiz Ortega Rossi Russo Esposito Ricci Conti Silva Santos Ferreira Costa Oliveira Khan Singh Sharma Gupta Tanaka Sato Chen Wang Kim Park Kowalski Novák Nagy Ivanov Petrov Hansen Lindberg Yılmaz Okafor Mensah Haddad".split()
TITLES = {
    "en": "Mr.|Mrs.|Ms.|Dr.|Prof.|Mr|Mrs|Dr|Sir|Miss",
    "de": "Herr|Frau|Frau Dr.|Herr Prof.|Dr.|Herr Dr.|Frau Prof.|Prof. Dr.|Dipl.-Ing.",
    "fr": "M.|Mme|Me|Mme le Dr|Dr|M. le Pr|Mlle|Pr|Maître",
    "es": "Sr.|Sra.|Don|Doña|Dra.|Dr.|D.|Dña.|Srta.|Prof.",
    "it": "Sig.|Sig.ra|Dott.|Dott.ssa|Ing.|Avv.|Prof.|Prof.ssa|Signor|Signora",
    "pt": "Sr.|Sra.|Dr.|Dra.|Eng.|Prof.|Sr. Dr.|Dona|Engª",
}
#: Syllables of invented family names and of invented makes.
_HEADS = "Fal Pel Tan Hol Mar Lin Gal Os Wes Kel Van Sil Bren Ror Stei Ard Mon Cor Ber Ash Har Ros Fer Wal Mor Cas Bel Duf Len Wit Ab Ein Ol Ur Sche Bru Cla Dre Gri Pra Tho".split()
_MIDS = ["", "", "", "ti", "mi", "lo", "be", "ve", "na", "ra", "do", "ne", "ri", "er", "an", "in"]
_TAILS = "wick dorf ini ado osc quist igny cedo reno schmitt heim valle sson ner son berg mann ez field worth eira eau ieri ley ton ham ski owa ert ard ault etti ucci inho aga ide oux el".split()
_BRAND_HEADS = "Lum Te No Ve Ka Bra Gri Ul Os Ha Dra Ze Que Sa Fe Mi Ys Ro To Pe Ke Sy Vo Al Cry De Xo Za Qui Blu Opt".split()
_BRAND_MIDS = ["", "", "lo", "vi", "ra", "no", "pa", "ka", "mo", "du", "ri", "ze", "ta", "bi", "xi", "ni"]
_BRAND_TAILS = "dane vex qet zor kor mar bor rix lith sten dium vane tron lex nova plex mix tel soft ware corp net dex ium ora eon".split()
_PLACE = "High Mill Church Park Station Garden Elm Oak Lake River Hill Bridge Castle Market King Queen North South Green Long Berg Wald Linden Bahnhof Schiller Goethe Garten Kirch Schul Haupt Feld Moulin Paix Liberté Gare Fleurs République Mayor Iglesia Prado Sol Flores Real Roma Garibaldi Verdi Mazzini Dante Carmo Liberdade Prata Flor Serra".split()
_TOWN_TAILS = "ford ton ham bury field mouth burg stadt hausen winkel moor münde dorf bach ville court mont clair arco sera vento lago osa alba ente ira mar oso porto beira".split()


def _word(r: random.Random, heads, mids, tails) -> str:
    return r.choice(heads) + r.choice(mids) + r.choice(tails)


def _digits(r: random.Random, n: int) -> str:
    """n digits; longer runs begin with zeros now and then, as numbers that are not in use do."""
    out = "".join(r.choice("0123456789") for _ in range(n))
    zeros = r.choice([0] * 12 + [2, 2, 3, 4]) if n > 2 else 0
    return ("0" * zeros + out)[:n]


def _letters(r: random.Random, n: int) -> str:
    return "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))


def _surname(r: random.Random) -> str:
    one = lambda: r.choice(FAMILY) if r.random() < 0.25 else _word(r, _HEADS, _MIDS, _TAILS)
    x = r.random()
    if x < 0.84:
        return one()
    if x < 0.88:
        return f"{one()}-{one()}"
    if x < 0.94:
        return f"{r.choice(['von', 'van', 'van der', 'de', 'de la', 'da', 'dos', 'di', 'del', 'Mc', 'le'])} {one()}".replace("Mc ", "Mc")
    if x < 0.96:
        return r.choice(["O’", "O'", "D’", "D'"]) + one()
    return f"{one()} {one()}"


def _given(r: random.Random, lang: str) -> str:
    x = r.random()
    if x < 0.6:
        return r.choice(GIVEN[lang].split())
    if x < 0.75:
        return r.choice(OTHERS)
    if x < 0.85:
        return r.choice(GIVEN[r.choice(list(GIVEN))].split())
    return _word(r, _HEADS, _MIDS, ["a", "o", "e", "i", "us", "an", "ia", "el", "is"])


def _name(r: random.Random, lang: str) -> str:
    sur, given, initial, title = _surname(r), _given(r, lang), r.choice("ABCDEGHJKLMNPRST") + ".", r.choice(TITLES[lang].split("|"))
    x = r.random()
    if x < 0.42:
        out = f"{given} {sur}"
    elif x < 0.55:
        out = f"{given} {initial} {sur}"
    elif x < 0.58:
        out = f"{given} {_given(r, lang)} {sur}"
    elif x < 0.72:
        out = f"{title} {sur}"
    elif x < 0.81:
        out = f"{title} {initial} {sur}"
    elif x < 0.85:
        out = f"{title} {given} {sur}"
    elif x < 0.89:
        out = f"{initial} {sur}"
    else:
        out = f"{sur}, {given}"
    return out.upper() if r.random() < 0.1 and "." not in out else out


def _fold(s: str) -> str:
    return re.sub("[^a-z]", "", unicodedata.normalize("NFKD", s.lower()))


def _low(r: random.Random) -> str:
    return _fold(_word(r, _BRAND_HEADS, _BRAND_MIDS, _BRAND_TAILS))


def _email(r: random.Random, lang: str) -> str:
    g, s, w = _fold(_given(r, lang)), _fold(_surname(r)), r.choice(["info", "office", "kontakt", "sales", "hello", "admin", "team", "service"])
    local = r.choice([f"{g}.{s}", f"{g}_{s}", f"{g}-{s}", g[:1] + s, s + _digits(r, r.randint(1, 4)), f"{s}.{g[:1]}", g + _digits(r, 2), f"{g}.{g[:1]}.{s}", w, _low(r), f"{s}", f"{g[:1]}.{s}{_digits(r, 2)}"])
    if r.random() < 0.15:
        local += "+" + r.choice(["scan", "x2", "lab", "news", _low(r)])
    host = r.choice([_low(r), _low(r), _low(r) + "-" + r.choice(["lab", "group", "it"]), r.choice(["mail", "web"]) + _digits(r, 1), s or "mail", "mail." + _low(r)])
    end = r.choice("com org net de fr es it pt eu io edu co.uk com.br example test invalid mail.example example".split())
    x = r.random()
    if x < 0.1:
        return f"{local} (at) {host} (dot) {end}"
    if x < 0.2:
        return f"{local}[at]{host}.{end}"
    if x < 0.23:
        return f"{local} [at] {host} [dot] {end}"
    if x < 0.3:
        return f"{local.upper()}@{host.upper()}.{end.upper()}"
    return f"{local}@{host}.{end}"


def _groups(r: random.Random, n: int, seps: str) -> str:
    """n digits in groups of two to four with one kind of separator."""
    sep, size, out = r.choice(seps), r.choice([2, 3, 3, 4]), []
    while n > 0:
        k = min(n, size if n - size != 1 else size + 1)
        out.append(_digits(r, k))
        n -= k
    return sep.join(out)


def _phone(r: random.Random, lang: str) -> str:
    d = lambda n: _digits(r, n)
    if r.random() < 0.3:  # any country: a code, or a trunk digit, and groups
        code = r.choice(["1", "44", "49", "33", "34", "39", "351", "41", "43", "55", "91", "81", d(2), d(3)])
        head = r.choice([f"+{code} ", f"+{code}-", f"+{code}", f"00{code} ", f"00{code}-", f"(+{code}) ", f"+{code} (0)", f"00{code}.", f"+{code} ({d(2)}) ", f"00{code}"])
        return head + _groups(r, r.randint(7, 10), "  --.")
    a = d(3)
    en = [f"1-{a}-555{d(4)}", f"({a}) {d(3)}-{d(4)}", f"001.{a}.{d(3)}.{d(4)}", f"+1 {a} {d(3)} {d(4)}", f"{a}-{d(3)}-{d(4)}", f"07{d(3)} {d(3)}{d(3)}", f"07{d(3)} {d(6)}", f"020 {d(4)} {d(4)}", f"1-{a}-{d(3)}-{d(4)}", f"{a}.{d(3)}.{d(4)}", f"+44 {d(4)} {d(3)} {d(3)}"]
    de = [f"0{d(2)}/{d(8)}", f"+49 {d(2)} {d(5)}-{d(3)}", f"(0{d(2)}) {d(8)}", f"0049 (0){d(2)} / {d(5)} {d(3)}", f"0{d(2)} {d(5)} {d(3)}", f"01{d(2)}-{d(7)}", f"0{d(3)} {d(6)}", f"01{d(2)} {d(7)}", f"0{d(4)}/{d(5)}"]
    fr = [f"0{d(3)} {d(2)} {d(4)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}-{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"0033 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}"]
    es = [f"{r.choice('69586')}{d(2)} {d(3)} {d(3)}", f"(+34) {d(3)}-{d(3)}-{d(3)}", f"+34 {d(3)} {d(3)} {d(3)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"{r.choice('6958')}{d(8)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}"]
    it = [f"{d(3)}/{d(6)}", f"+39 {d(3)} {d(3)} {d(3)}", f"3{d(2)} {d(6)}", f"{d(3)} {d(2)} {d(1)} {d(3)}", f"0{d(1)} {d(4)} {d(4)}", f"3{d(2)} {d(3)} {d(4)}"]
    pt = [f"+351 {d(3)} {d(3)} {d(3)}", f"00351-{d(9)}", f"9{d(2)} {d(3)} {d(3)}", f"{r.choice('259')}{d(2)} {d(3)} {d(3)}", f"21{d(1)} {d(3)} {d(3)}"]
    return r.choice({"en": en, "de": de, "fr": fr, "es": es, "it": it, "pt": pt}[lang])


def _id(r: random.Random, lang: str) -> str:
    d, c = lambda n: _digits(r, n), lambda n: _letters(r, n)
    kinds = {
        "en": [f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{c(1)}{d(8)}", f"{c(2)}{d(6)}{c(1)}", d(9), f"{c(2)}{d(7)}"],
        "de": [f"{c(1)}{d(2)}{c(1)}{d(2)}{c(1)}{d(2)}", f"{c(1)}{d(1)}{c(1)}{d(2)}{c(1)}{d(2)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{c(1)}{d(8)}", f"{d(2)} {d(6)} {c(1)} {d(3)}"],
        "fr": [f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('12')}{d(14)}", f"{d(2)}{c(2)}{d(5)}", f"{d(2)} {d(2)} {d(3)} {d(3)} {d(3)}", d(12)],
        "es": [f"{d(2)}.{d(3)}.{d(3)}-{c(1)}", f"{d(8)}{c(1)}", f"{d(8)}Ñ", f"{d(8)}-{c(1)}", f"{c(1)}{d(7)}{c(1)}", f"{c(1)}-{d(7)}-{c(1)}", f"{c(3)}{d(6)}"],
        "it": [f"{c(6)}{d(2)}{c(1)}{d(2)}{c(1)}{d(3)}{c(1)}", f"{c(2)}{d(7)}", f"{c(3)} {c(3)} {d(2)}{c(1)}{d(2)} {c(1)}{d(3)}{c(1)}", f"{c(2)}{d(5)}{c(2)}"],
        "pt": [f"{d(3)}.{d(3)}.{d(3)}", d(9), f"{d(3)} {d(3)} {d(3)}", f"{d(8)} {d(1)} {c(2)}{d(1)}", f"{c(1)}{d(6)}"],
    }
    return r.choice(kinds[lang])


def _street(r: random.Random) -> str:
    return r.choice(_PLACE) if r.random() < 0.5 else _surname(r) if r.random() < 0.3 else _word(r, _HEADS, _MIDS, _TAILS)


def _town(r: random.Random) -> str:
    one = lambda: _word(r, _HEADS, _MIDS, _TOWN_TAILS) if r.random() < 0.8 else r.choice(_PLACE) + r.choice(_TOWN_TAILS)
    return one() if r.random() < 0.85 else f"{r.choice(['San', 'Bad', 'Saint', 'New', 'Vila', 'Santa', 'Port', 'Neu', 'Le', 'La', 'Castel', 'São', 'Great'])} {one()}"


def _address(r: random.Random, lang: str) -> str:
    s, town, n, zip5 = _street(r), _town(r), str(r.randint(1, 240)), _digits(r, 5)
    way = r.choice("Street Road Avenue Lane Drive Close Court Way Square Terrace St Rd Ave Dr Blvd Crescent".split())
    x = r.choice(["", "", "", "a", "B", " bis"])
    weg = r.choice("straße weg gasse allee platz ring str. ufer damm".split())
    flat = r.choice(["", "", "", f", Apt. {r.randint(1, 40)}", f", Flat {r.randint(1, 20)}", f", Unit {_digits(r, 2)}"])
    rue = r.choice("rue|avenue|boulevard|allée|impasse|place|quai|chemin|cours".split("|")) + r.choice([" ", " ", " de ", " de la ", " des ", " du "])
    calle = r.choice("calle|avenida|plaza|paseo|C/|Calle|Avda.|camino".split("|")) + r.choice([" ", " ", " de ", " de la ", " del "])
    via = r.choice("via|viale|piazza|corso|vicolo|largo|Via|Piazza|strada".split("|")) + r.choice([" ", " ", " della ", " dei ", " di "])
    rua = r.choice("rua|avenida|travessa|praça|largo|Rua|Av.|alameda|Travessa".split("|")) + r.choice([" ", " do ", " da ", " de ", " dos "])
    forms = {
        "en": [f"{n} {s} {way}{flat}, {town} {zip5}", f"{n} {s} {way}, {town} {zip5}", f"{n} {s} {way} in {town} {zip5}", f"{n} {s} {way}, {town}, {_letters(r, 2)} {zip5}", f"{n} {s} {way}, {town} {_letters(r, 2)}{_digits(r, 1)} {_digits(r, 1)}{_letters(r, 2)}", f"{n} {s} {_street(r)} {way}, {town} {zip5}", f"{n}{x.strip()} {s} {way}, {zip5} {town}"],
        "de": [f"Am {s} {n}, {zip5} {town}", f"{s}er Straße {n}, {zip5} {town}", f"{s}{weg} {n} in {zip5} {town}", f"{s}{weg} {n}{x}, D-{zip5} {town}", f"{s}{weg} {n}{x}, {zip5} {town}", f"An der {s} {n}, {zip5} {town}", f"{s}-{weg.capitalize()} {n}, {zip5} {town}"],
        "fr": [f"{n}{x} {rue}{s}, {zip5} {town}", f"{n}, {rue}{s}, {zip5} {town}", f"{n} {rue}{s} – {zip5} {town}", f"{n} {rue}{s} {_street(r)}, {zip5} {town}", f"{n} {rue}{s}, {zip5} {town} CEDEX"],
        "es": [f"{calle}{s}, {n}, {zip5} {town}", f"{calle}{s} {n}, {zip5} {town}", f"{calle}{s} {n}, {r.randint(1, 9)}.º {_letters(r, 1)}, {zip5} {town}", f"{calle}{s} nº {n}, {zip5} {town}"],
        "it": [f"{via}{s} n. {n}, {zip5} {town}", f"{via}{s}, {n} - {zip5} {town}", f"{via}{s} {n}, {zip5} {town}", f"{via}{s} {n}{x.strip()}, {zip5} {town} ({_letters(r, 2)})"],
        "pt": [f"{rua}{s}, {n}, {_digits(r, 4)}-{_digits(r, 3)} {town}", f"{rua}{s} n.º {n}, {_digits(r, 4)}-{_digits(r, 3)} {town}", f"{rua}{s} {n}, {_digits(r, 4)}-{_digits(r, 3)} {town}", f"{rua}{s} {n}, {r.randint(1, 9)}.º Esq., {_digits(r, 4)}-{_digits(r, 3)} {town}"],
    }
    return r.choice(forms[lang])


def _code(r: random.Random) -> str:
    return r.choice(["INC-", "RX-", "K.", "T/", "DOC", "#", "REF ", "PO-", "S/N ", "TK", "A-", "No. ", "Q/"]) + _digits(r, r.choice([4, 5, 6, 7]))


_SLOTS = {"name": _name, "email": _email, "phone": _phone, "id_number": _id, "address": _address}
_PART = re.compile(r"\{(\w+)\}|<(n|brand|low|grp|grp9|ip|ver|time|date|year|model|code)>")


def _filler(r: random.Random, what: str) -> str:
    d = lambda n: _digits(r, n)
    return {
        "n": lambda: str(r.randint(1, r.choice([9, 99, 999, 3999, 60000]))),
        "brand": lambda: (lambda b: b.upper() if r.random() < 0.08 else b)(_word(r, _BRAND_HEADS, _BRAND_MIDS, _BRAND_TAILS)),
        "low": lambda: _low(r),
        "grp": lambda: r.choice([f"{d(3)} {d(3)} {d(3)}-{d(r.choice([3, 4]))}", f"{d(4)} {d(4)} {d(4)}", f"{d(8)}", f"{d(3)}-{d(4)}-{d(3)}"]),
        "grp9": lambda: r.choice([f"{d(3)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(9)}", f"{d(2)} {d(4)} {d(3)}"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "ver": lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 40)}",
        "time": lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}",
        "date": lambda: r.choice([f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.20{d(2)}", f"20{d(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{d(2)}"]),
        "year": lambda: str(r.randint(700, 2999)),
        "model": lambda: r.choice([f"{_letters(r, 2)}{d(1)}{_letters(r, 1)}-{d(2)}", f"{_letters(r, 1)}0-{r.choice('lIO')}{d(2)}", f"{_letters(r, 2).lower()}{d(2)}{r.choice('kx')}", f"{r.choice('lI')}1O{d(2)}", f"{_letters(r, 1)}-{d(3)}"]),
        "code": lambda: _code(r),
    }[what]()


#: Names of the fields of forms, by language and kind; ``code`` is for numbers that are not personal.
FIELDS = {
    "en": {"name": "Name|Full name|Contact|Applicant|Owner", "phone": "Phone|Tel.|Telephone|Mobile|Cell|Phone number", "email": "E-mail|Email|Mail", "address": "Address|Home address|Street", "id_number": "ID|ID number|SSN|Passport|Passport no.|Tax number|National insurance no.", "code": "Order no.|Item no.|File no.|Serial|Reference|Catalogue no.|Version|Port"},
    "de": {"name": "Name|Ansprechpartner|Antragsteller|Inhaber", "phone": "Telefon|Tel.|Handy|Mobil|Rufnummer", "email": "E-Mail|Mail", "address": "Anschrift|Adresse|Wohnort", "id_number": "Ausweis|Ausweisnummer|Pass|Reisepass Nr.|Steuer-ID|Sozialversicherungsnummer", "code": "Auftrag Nr.|Artikel Nr.|Akte Nr.|Seriennummer|Kennung|Bestellnummer"},
    "fr": {"name": "Nom|Nom complet|Contact|Demandeur", "phone": "Tél.|Téléphone|Portable|Mobile", "email": "Courriel|E-mail|Mél", "address": "Adresse|Domicile", "id_number": "N° d’identité|Passeport|Passeport n°|N° fiscal|N° de sécurité sociale", "code": "Commande n°|Article n°|Dossier n°|Série|Référence"},
    "es": {"name": "Nombre|Contacto|Solicitante|Titular", "phone": "Teléfono|Tel.|Móvil", "email": "Correo|E-mail|Correo electrónico", "address": "Domicilio|Dirección", "id_number": "DNI|NIE|Pasaporte|Pasaporte n.º|N.º fiscal", "code": "Pedido n.º|Artículo n.º|Expediente n.º|Serie|Referencia"},
    "it": {"name": "Nome|Contatto|Richiedente|Titolare", "phone": "Telefono|Tel.|Cellulare|Cell.", "email": "Posta|E-mail|Mail", "address": "Indirizzo|Residenza|Domicilio", "id_number": "Codice fiscale|C.F.|Passaporto|Passaporto n.|Carta d’identità", "code": "Ordine n.|Articolo n.|Pratica n.|Serie|Riferimento"},
    "pt": {"name": "Nome|Contacto|Requerente|Titular", "phone": "Telefone|Tel.|Telemóvel", "email": "Correio|E-mail", "address": "Morada|Endereço|Residência", "id_number": "NIF|Contribuinte|Passaporte|Passaporte n.º|Cartão de cidadão", "code": "Encomenda n.º|Artigo n.º|Processo n.º|Série|Referência"},
}


def _form(r: random.Random, lang: str) -> str:
    """Fields of a form in any order, on lines or one after the other."""
    mark, gap = r.choice([": ", ": ", ":", ":\t", " – ", " - ", " : "]), r.choice(["¶", "¶", " ", ", "])
    out = []
    for kind in r.sample([*_SLOTS, "code"], r.randint(1, 5)):
        value = r.choice(["<grp9>", "<grp>", "<code>", "<model>", "<n>", "<ver>"]) if kind == "code" else "{" + kind + "}"
        out.append(r.choice(FIELDS[lang][kind].split("|")) + mark + value)
    return gap.join(out)


#: Nouns after which a number is no one's, and names of firms, houses and works with a make in them.
NUMBERED = "order no.|item no.|article no.|file no.|catalogue no.|part no.|volume no.|Catalogue no.|Order no.|Artikel Nr.|Auftrag Nr.|Akte Nr.|Bestellung Nr.|article n°|commande n°|dossier n°|réf. n°|pedido n.º|artículo n.º|expediente n.º|articolo n.|ordine n.|pratica n.|artigo n.º|processo n.º|encomenda n.º|checksum|the checksum|Prüfsumme|Die Prüfsumme|somme|suma|somma|soma|batch|Batch|Charge|lot|lote|Lote|lotto|partita|Die Lieferung|serial number|Seriennummer|numéro de série"
FIRMS = "Werke|Group|Verlag|Verein|Institut|Institute|Stiftung|University|School|Company|Partners|Systems|Bank|Hotel|Museum|Library|Society|Records|Tools|Editions|Industries|Consulting|Universität|Schule|Bibliothek|Gesellschaft|Éditions|Société|École|Sociedad|Escuela|Grupo|Società|Scuola|Gruppo|Sociedade|Escola"


def _usual(r: random.Random, lang: str, n: int) -> list[str]:
    """A run of usual words; German nouns keep their capital."""
    words = COMMON[lang].split()
    at = r.randrange(len(words))
    out = [r.choice(words) for _ in range(n)] if r.random() < 0.6 else (words * 2)[at : at + n]
    return [w.capitalize() if lang == "de" and r.random() < 0.3 else w for w in out]


def _free(r: random.Random, lang: str) -> str:
    """A sentence of usual words with at most two items or look-alikes anywhere in it."""
    parts: list[str] = _usual(r, lang, r.randint(2, 7))
    for _ in range(r.choice([0, 1, 1, 1, 2])):
        x = r.random()
        if x < 0.2:  # several items side by side
            kinds = r.sample(list(_SLOTS), r.choice([2, 2, 3]))
            if r.random() < 0.4:
                kinds = r.choice([["name", "address"], ["address", "phone"], ["address", "phone"], ["name", "email"], ["name", "phone"]])
            link = r.choice([" / ", ", ", ", ", "; ", " – ", " ", " · ", " | "])
            run = link.join((r.choice(BEFORE[k].split("|")) + " " if k == "id_number" else "") + "{" + k + "}" for k in kinds)
            parts.append(r.choice(["{}", "({})", "[{}]", "– {}", "– {}", "c/o {}", "<{}>", "mailto:{}" if kinds[0] == "email" else "{}"]).format(run))
        elif x < 0.68:
            kind = r.choice(["name", "name", "name", "email", "phone", "phone", "id_number", "id_number", "address", "address", "address"])
            needed = kind in ("id_number", "phone")  # a bare number could be anyone's or anything's
            if needed or r.random() < 0.6:
                parts.append(r.choice(BEFORE[kind].split("|")))
            parts.append("{" + kind + "}")
        else:
            y = r.random()
            parts.append(f"{r.choice(NUMBERED.split('|'))} {r.choice(['<grp9>', '<grp9>', '<grp>', '<code>'])}" if y < 0.3 else f"<brand> {r.choice(FIRMS.split('|'))}" if y < 0.42 else r.choice(LIKE.split("|")))
        parts += _usual(r, lang, r.randint(0, 6))
    if r.random() < 0.25:  # an item first
        parts = [r.choice(["{name}", "{name}", "{name}", "<brand>"])] + parts[r.randint(0, 2) :]
    for _ in range(r.choice([0, 0, 1, 2]) if len(parts) > 3 else 0):
        parts[r.randrange(0, len(parts) - 1)] += r.choice([",", ",", ";", ":", " –", ". " + r.choice(parts[:1]).capitalize()])
    line = " ".join(parts)
    return (line if line[0] in "{<" else line[0].upper() + line[1:]) + r.choice([".", ".", ".", "", "!", "?"])


def _heading(r: random.Random, lang: str) -> str:
    words = [w.capitalize() for w in _usual(r, lang, r.randint(1, 4))]
    words.insert(r.randrange(len(words) + 1), "<brand>")
    line = " ".join(words)
    line = r.choice([line, line, f"<n> {line}", f"{line} <n>", f"<n>   {line}", f"- <n> -\n{line}", f"{line}: {line}"])
    return line.upper().replace("<BRAND>", "<brand>").replace("<N>", "<n>") if r.random() < 0.4 else line


def _listing(r: random.Random) -> str:
    """A log or a directory listing: nothing in it is personal."""
    if r.random() < 0.6:
        return "\n".join(
            f"20{r.randint(10, 39)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02} {r.choice(['INFO', 'WARN', 'DEBUG', 'ERROR', 'TRACE'])} [{_low(r)}] {_low(r)}={r.randint(1, 9999)} {_low(r)}=0.{_digits(r, 3)}"
            for _ in range(r.randint(1, 6))
        )
    marks = ["├── ", "└── ", "│   ├── ", "│   └── ", "  - ", "/"]
    return _low(r) + "\n" + "\n".join(r.choice(marks) + _low(r) + r.choice(["/", ".txt", ".md", ".py", ".csv", ".pdf"]) for _ in range(r.randint(2, 8)))


def _line(r: random.Random, lang: str, plain: list[str], lines: list[str]) -> str:
    x = r.random()
    if plain and x < 0.12:
        return r.choice(plain)
    return _free(r, lang) if x < 0.52 else _heading(r, lang) if x < 0.58 else _form(r, lang) if x < 0.68 else r.choice(lines)


def labelled(count: int, seed: int, plain: dict[str, list[str]] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` filled texts of one to four lines with their items; plain: ordinary sentences by language."""
    r = random.Random(seed)
    lines = {k: v.split("\n") for k, v in LINES.items()}
    out = []
    while len(out) < count:
        lang = r.choice(list(lines))
        pool = plain.get(lang, []) if plain else []
        parts = [_line(r, lang, pool, lines[lang]) for _ in range(r.randint(1, 4))]
        text, spans = "", []
        log = r.random() < 0.04
        if log:
            parts = [_listing(r)]
        bullets = r.random() < 0.12
        form = r.random() < 0.5
        mark = r.choice([": ", ":", ":\t", " – ", " - "]) if r.random() < 0.3 else None
        for k, part in enumerate(parts):
            if k:
                text += "\n" if bullets or log or text.endswith("\n") else r.choice([" ", " ", " ", "\n\n"])
            if bullets:
                text += r.choice(["- ", "* "])
            if mark and "¶" in part:
                part = part.replace(" : ", mark).replace(": ", mark)
            at = 0
            for m in _PART.finditer(part):
                text += part[at : m.start()].replace("¶", "\n" if form else r.choice(["\n", " "]))
                at = m.end()
                if m[1]:
                    value = _SLOTS[m[1]](r, lang)
                    spans.append((len(text), len(text) + len(value), m[1]))
                else:
                    value = _filler(r, m[2])
                text += value
            text += part[at:].replace("¶", "\n" if form else " ")
        if r.random() < 0.4:  # wrapped lines, as long as the text stays the same length
            width, col, chars = r.choice([40, 50, 60, 72]), 0, list(text)
            last = None
            for i, ch in enumerate(chars):
                col = 0 if ch == "\n" else col + 1
                last = i if ch == " " else None if ch == "\n" else last
                if col > width and last is not None:
                    chars[last], col, last = "\n", i - last, None
            text = "".join(chars)
        out.append((text, spans))
    return out
