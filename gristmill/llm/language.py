"""Languages of files and of passages, by compression.

Each language has a zstandard dictionary of raw content: common words of the language and the
labelled samples. A text belongs to the language whose dictionary makes it smallest; where the
runner-up comes too near, it is rejected and has no language.

A block is read as sentences, and each sentence is compressed with every dictionary; all
sentences of an Arrow batch go through a dictionary in one call. Sentence sizes by language are
summed by file, the language of most of a file's text is its main one, and a block departs from
it where it holds at least one whole sentence of another language.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.metadata import canonical_language
from gristmill.session import durable

LEVEL = 3
#: Bytes and share of the runner-up's size by which the smallest size must win.
MARGIN, MARGIN_SHARE = 3, 0.04
#: Share of the size under a file's main language by which a whole sentence must be smaller under its own to depart from it.
DEPART = 0.15
#: Characters of labelled samples a dictionary takes in per language; samples are sorted by number.
SAMPLE_CHARS = 1 << 16

#: Labelled blocks looked at and characters taken in a language to fit the dictionaries to the corpus; the margin
#: by which a sentence's language must win to be taken, and the share of it that must be new.
FIT_ROWS, FIT_CHARS, FIT_MARGIN, FIT_NEW = 1_500, 12_000, 0.2, 0.25

#: Function words of each language, and usual words of homes, offices and archives: the same list in every language.
COMMON = {
    "en": "the price the model the catalogue the list the page the pages the report the office the library the laboratory the research the memory the network the server the port the node the version the building the room the floor the invoice the order the box the letter the key the door the copy the contract the form the table the picture the book the note the guide the manual the result the test the check the team the colleague the user the data the file the folder the record the archive the machine the system the message the call the service the storage the delivery the load the station the animal the garden the street the morning the evening the night percent heading percentage compared replaced restored measured delivered postponed rejected collected monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december year years day days week weeks month months time people man woman child house home hand head eye water work world life country city number thing things way part place case point group company question problem fact letter word line side end name new old good great small large long little young high right different important same own early late able made make makes making said say says went go goes going came come comes coming took take takes took taken given give gives found find finds known know knows seen see sees thought think thinks used use uses using asked called tried left put kept let began seem seems showed heard played ran moved lived believed held brought happened wrote written provided sat stood lost paid met included continued set learned changed led understood watched followed stopped created spoke read allowed added spent grew opened walked won offered remembered loved considered appeared bought waited served died sent expected built stayed fell cut reached killed remained the of and to in is was were with for from had been this that which their there they them his her has have not are by on at it its be an as or but if when while after before because although than then each every other into over under about between through during what who where how many how much did does more most some any no all can could will would should may might must please only also still just very first last next",
    "de": "der preis das modell der katalog die liste die seite die seiten der bericht das büro die bibliothek das labor die forschung der speicher das netz der server der anschluss der knoten die fassung das gebäude der raum das stockwerk die rechnung die bestellung der kasten der brief der schlüssel die tür die kopie der vertrag das formular die tabelle das bild das buch die notiz der leitfaden das handbuch das ergebnis die prüfung die gruppe der kollege der nutzer die daten die datei der ordner der eintrag das archiv die maschine das system die nachricht der anruf der dienst das lager die lieferung die ladung die station das tier der garten die straße der morgen der abend die nacht prozent überschrift verglich ersetzte wiederhergestellt gemessen geliefert verschoben abgelehnt gesammelt montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz april mai juni juli august september oktober november dezember jahr jahre jahren tag tage tagen woche wochen monat monate zeit leute mann frau kind kinder haus hand kopf auge wasser arbeit welt leben land stadt zahl sache weg teil ort stelle fall punkt gruppe firma frage problem tatsache brief wort zeile seite ende name neu neue neuen neuer alt alte alten gut gute guten groß große großen klein kleine kleinen lang lange jung hoch hohe richtig wichtig gleich eigen früh spät machen macht gemacht sagen sagt gesagt gehen geht ging gegangen kommen kommt kam gekommen nehmen nahm genommen geben gibt gab gegeben finden fand gefunden wissen weiß wusste sehen sieht sah gesehen denken dachte gebraucht gefragt gerufen versucht verlassen gehalten begann begonnen scheint zeigte gehört lief gelaufen lebte glaubte brachte gebracht geschah schrieb geschrieben stand verlor bezahlt getroffen gelernt geändert verstanden gefolgt las gelesen erlaubt öffnete gewonnen angeboten gekauft gewartet gestorben geschickt gebaut blieb geblieben fiel gefallen erreicht können kann konnte müssen muss musste sollen soll sollte wollen will wollte dürfen darf der die das den dem des ein eine einen einem einer und oder aber ist sind war waren wurde wurden wird werden hat haben hatte nicht mit von vom zu zum zur im in ins auf aus bei nach vor für über unter durch gegen ohne um am an als wie wenn weil dass obwohl während bevor damit noch auch nur sehr mehr kein keine sich sie er es wir ihr ihre seine dieser diese dieses jeder jede jedes welche was wer wo wann warum bitte davon etwa zwischen hinter neben seit bis",
    "fr": "le prix le modèle le catalogue la liste la page les pages le rapport le bureau la bibliothèque le laboratoire la recherche la mémoire le réseau le serveur le port le nœud la version le bâtiment la salle l’étage la facture la commande la boîte la lettre la clé la porte la copie le contrat le formulaire le tableau l’image le livre la note le guide le manuel le résultat l’essai le contrôle l’équipe le collègue l’utilisateur les données le fichier le dossier la fiche les archives la machine le système le message l’appel le service le stockage la livraison le chargement la station l’animal le jardin la rue le matin le soir la nuit pour cent titre a comparé a remplacé a restauré a mesuré a livré a reporté a refusé a rassemblé lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril mai juin juillet août septembre octobre novembre décembre an ans année années jour jours semaine semaines mois temps gens homme femme enfant enfants maison main tête œil yeux eau travail monde vie pays ville nombre chose choses chemin partie lieu place cas point groupe société question problème fait lettre mot ligne côté fin nom nouveau nouvelle nouveaux vieux vieille bon bonne grand grande grands petit petite petits long longue jeune haut haute vrai important même propre tôt tard faire fait faisait dire dit disait aller va allait allé venir vient venait venu prendre prend pris donner donne donné trouver trouve trouvé savoir sait savait voir voit vu penser pense pensé utilisé demandé appelé essayé laissé mis gardé commencé semble montré entendu couru vécu cru tenu apporté arrivé écrit fourni assis debout perdu payé rencontré appris changé conduit compris regardé suivi arrêté créé parlé lu permis ajouté passé grandi ouvert marché gagné offert aimé acheté attendu servi mort envoyé construit resté tombé atteint pouvoir peut pouvait devoir doit devait vouloir veut voulait le la les un une des du de et ou mais est sont était étaient a ont été avec pour par sur sous dans chez sans vers entre que qui quoi dont où ce cette ces cet son sa ses leur leurs il elle ils elles nous vous on ne pas plus moins très aussi encore puis donc car si quand comme avant après pendant depuis jusque lorsque afin bien l’ d’ qu’ n’ s’ c’ j’ aux au tout toute tous toutes chaque autre quel quelle combien",
    "es": "el precio el modelo el catálogo la lista la página las páginas el informe la oficina la biblioteca el laboratorio la investigación la memoria la red el servidor el puerto el nodo la versión el edificio la sala el piso la factura el pedido la caja la carta la llave la puerta la copia el contrato el formulario la tabla la imagen el libro la nota la guía el manual el resultado la prueba la revisión el equipo el compañero el usuario los datos el archivo la carpeta la ficha el archivo la máquina el sistema el mensaje la llamada el servicio el almacenamiento la entrega la carga la estación el animal el jardín la calle la mañana la tarde la noche por ciento título comparó sustituyó restauró midió entregó aplazó rechazó reunió figura respondió lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre año años día días semana semanas mes meses tiempo gente hombre mujer niño niños casa mano cabeza ojo ojos agua trabajo mundo vida país ciudad número cosa cosas camino parte lugar caso punto grupo empresa pregunta problema hecho carta palabra línea lado fin nombre nuevo nueva nuevos viejo vieja bueno buena gran grande grandes pequeño pequeña largo larga joven alto alta verdad importante mismo misma propio temprano tarde hacer hace hizo hecho decir dice dijo dicho ir va fue ido venir viene vino tomar toma tomó tomado dar da dio dado encontrar encuentra encontró encontrado saber sabe sabía ver ve vio visto pensar piensa pensó usado pedido llamado intentado dejado puesto guardado empezó parece mostró oído corrió vivió creyó tenido traído llegado escrito sentado perdido pagado conocido aprendido cambiado entendido mirado seguido parado creado hablado leído permitido añadido pasado crecido abierto andado ganado ofrecido comprado esperado servido muerto enviado construido quedado caído alcanzado poder puede podía deber debe debía querer quiere quería el la los las un una unos unas de del y o pero es son era eran fue fueron ha han había con para por sobre bajo en sin entre hasta desde hacia que quien cual cuyo donde cuando como este esta estos estas ese esa su sus lo le les se no sí más menos muy también todavía ya porque aunque mientras antes después durante si al cada otro otra todo toda todos todas qué quién cuál cuánto cuántas está están tiene",
    "it": "il prezzo il modello il catalogo l’elenco la pagina le pagine la relazione l’ufficio la biblioteca il laboratorio la ricerca la memoria la rete il server la porta il nodo la versione l’edificio la sala il piano la fattura l’ordine la scatola la lettera la chiave la porta la copia il contratto il modulo la tabella l’immagine il libro la nota la guida il manuale il risultato la prova il controllo la squadra il collega l’utente i dati il documento la cartella la scheda l’archivio la macchina il sistema il messaggio la chiamata il servizio il deposito la consegna il carico la stazione l’animale il giardino la strada la mattina la sera la notte per cento titolo ha confrontato ha sostituito ha riparato ha misurato ha consegnato ha rinviato ha respinto ha raccolto sceso salito lunedì martedì mercoledì giovedì venerdì sabato domenica gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre anno anni giorno giorni settimana settimane mese mesi tempo gente uomo donna bambino bambini casa mano testa occhio occhi acqua lavoro mondo vita paese città numero cosa cose strada parte luogo posto caso punto gruppo società domanda problema fatto lettera parola riga lato fine nome nuovo nuova nuovi vecchio vecchia buono buona grande grandi piccolo piccola lungo lunga giovane alto alta vero importante stesso stessa proprio presto tardi fare fa fatto dire dice disse detto andare va andato venire viene venuto prendere prende preso dare dà dato trovare trova trovato sapere sa sapeva vedere vede visto pensare pensa pensato usato chiesto chiamato provato lasciato messo tenuto cominciò sembra mostrò sentito corse visse credeva portato successo scritto fornito seduto perso pagato incontrato imparato cambiato guidato capito guardato seguito fermato creato parlato letto permesso aggiunto passato cresciuto aperto camminato vinto offerto amato comprato aspettato servito morto mandato costruito rimasto caduto raggiunto potere può poteva dovere deve doveva volere vuole voleva il lo la i gli le un uno una di del dello della dei degli delle e o ma è sono era erano fu ha hanno aveva stato stata con per su sul sulla sotto in nel nella nei senza tra fra fino da dal dalla che chi cui dove quando come questo questa questi queste quello quella suo sua suoi loro non più meno molto anche ancora già perché poiché mentre prima dopo durante se ogni altro altra tutto tutta tutti quale quanti quante al allo alla ai agli alle",
    "pt": "o preço o modelo o catálogo a lista a página as páginas o relatório o escritório a biblioteca o laboratório a pesquisa a memória a rede o servidor a porta o nó a versão o edifício a sala o andar a fatura a encomenda a caixa a carta a chave a porta a cópia o contrato o formulário a tabela a imagem o livro a nota o guia o manual o resultado o teste a revisão a equipa o colega o utilizador os dados o ficheiro a pasta a ficha o arquivo a máquina o sistema a mensagem a chamada o serviço o armazenamento a entrega a carga a estação o animal o jardim a rua a manhã a tarde a noite por cento título comparou substituiu restaurou mediu entregou adiou rejeitou reuniu palavras observações respondeu desceu segunda terça quarta quinta sexta sábado domingo janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro ano anos dia dias semana semanas mês meses tempo gente homem mulher criança crianças casa mão cabeça olho olhos água trabalho mundo vida país cidade número coisa coisas caminho parte lugar caso ponto grupo empresa pergunta problema facto carta palavra linha lado fim nome novo nova novos velho velha bom boa grande grandes pequeno pequena longo longa jovem alto alta verdade importante mesmo mesma próprio cedo tarde fazer faz fez feito dizer diz disse dito ir vai foi ido vir vem veio tomar toma tomou tomado dar dá deu dado encontrar encontra encontrou encontrado saber sabe sabia ver vê viu visto pensar pensa pensou usado pedido chamado tentado deixado posto guardado começou parece mostrou ouvido correu viveu acreditou tido trazido chegado escrito sentado perdido pago conhecido aprendido mudado entendido olhado seguido parado criado falado lido permitido acrescentado passado crescido aberto andado ganho oferecido comprado esperado servido morto enviado construído ficado caído alcançado poder pode podia dever deve devia querer quer queria o a os as um uma uns umas de do da dos das e ou mas é são era eram foi foram tem têm havia com para por pelo pela sobre sob em no na nos nas sem entre até desde que quem qual cujo onde quando como este esta estes estas esse essa isso seu sua seus suas lhe se não sim mais menos muito também ainda já porque embora enquanto antes depois durante cada outro outra todo toda todos todas ao aos à às já não está",
}
LANGUAGES = tuple(COMMON)

_SPLIT = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[-*•>#]|\d{1,3}[.)])[ \t]|[ \t]{8,})|(?<=[.!?…])[\"'’”»)\]]*\s+(?=[\"'“„«(\[¿¡]{0,2}[^\W\d_a-zà-öø-ÿ])")
_WHOLE_START = re.compile(r"^[-*•>#\s\d.)]{0,6}[\"'“„«(\[¿¡]{0,2}[^\W\d_a-zà-öø-ÿ]")
_WHOLE_END = re.compile(r"[.!?…][\"'’”»)\]]{0,3}$")
_HYPHEN = re.compile("[-\xad¬‐]\n\\s*(?=[a-zà-öø-ÿ])")
_NO_WORD = re.compile(r"[\d@\\/_]")
_LETTER_WORD = re.compile(r"[^\W\d_]{2,}")
_LISTING = re.compile(r"[├└│]|^\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^[\w./\\-]+\s*$", re.M)
#: Letters-only words that a whole sentence has at least.
SENTENCE_WORDS = 4


class Classifier:
    def __init__(self, samples: dict[str, str], level: int = LEVEL):
        import zstandard

        self.packers = []
        for lang in LANGUAGES:
            raw = f"{COMMON[lang]} {samples.get(lang, '').lower()}".encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.frame = len(self.packers[0].compress(b""))

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Compressed sizes: texts x languages. All texts go through a dictionary in one call where the library has one for it."""
        if not texts:
            return np.zeros((0, len(self.packers)), np.int64)
        texts = [t or b" " for t in texts]
        if hasattr(self.packers[0], "multi_compress_to_buffer"):
            cols = [np.fromiter(map(len, p.multi_compress_to_buffer(texts, threads=1)), np.int64, len(texts)) for p in self.packers]
        else:
            cols = [np.fromiter((len(p.compress(t)) for t in texts), np.int64, len(texts)) for p in self.packers]
        return np.stack(cols, 1)

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, confidence, sizes) of each text: the language's number, -1 where the margin is narrow or the text empty."""
        sizes = self.sizes(texts)
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0), sizes
        two = np.partition(sizes, 1, 1)[:, :2]
        gap, sure = two[:, 1] - two[:, 0], (two[:, 1] - two[:, 0]) / two[:, 1]
        return np.where((gap >= MARGIN) & (sure >= MARGIN_SHARE), sizes.argmin(1), -1), sure, sizes

    def language(self, text: str) -> tuple[str | None, float]:
        """The language of a text with a confidence from 0 to 1; none where the margin is narrow."""
        data = telling(" ".join(text.split()))
        if not data:
            return None, 0.0
        (lang,), (sure,), _ = self.judged([data])
        return (LANGUAGES[lang] if lang >= 0 else None), float(sure)

    def passages(self, texts: list[str | None]) -> list[list[tuple[str | None, int, list[float] | None, float]]]:
        """Of each text (language, characters, lead, sum of confidence times characters).

        lead: for each language, the largest share of its size by which a whole sentence is smaller under
        its own language; none where the text has no whole sentence in it.
        """
        owners, sentences = [], []
        for i, t in enumerate(texts):
            for s in sentences_of(t):
                owners.append(i), sentences.append(s)
        langs, sures, sizes = self.judged([telling(s) for s in sentences])
        leads = 1 - sizes[np.arange(len(sizes)), langs][:, None] / np.maximum(1, sizes)
        found: list[dict[int, list]] = [{} for _ in texts]
        for k, (i, s, lang, sure) in enumerate(zip(owners, sentences, langs.tolist(), sures.tolist())):
            f = found[i].get(lang)
            if f is None:
                f = found[i][lang] = [0, None, 0.0, False]
            f[0] += len(s)
            f[2] += sure * len(s)
            if lang >= 0 and not f[3] and is_whole(s):
                f[1] = leads[k] if f[1] is None else np.maximum(f[1], leads[k])
                f[3] = sure >= DEPART  # then it leads every other language by enough
        # too little to tell by sentence: the text as a whole
        short = [i for i, f in enumerate(found) if len(f) == 1 and -1 in f]
        whole, sures, _ = self.judged([telling(" ".join(sentences_of(texts[i]))) for i in short])
        for i, lang, sure in zip(short, whole.tolist(), sures.tolist()):
            if lang >= 0:
                n = found[i].pop(-1)[0]
                found[i][lang] = [n, None, sure * n, True]
        return [[(LANGUAGES[lang] if lang >= 0 else None, n, None if lead is None else lead.tolist(), c) for lang, (n, lead, c, _) in f.items()] for f in found]


def telling(sentence: str) -> bytes:
    """What tells a sentence's language: its words in lower case without those with digits, addresses and paths."""
    if _NO_WORD.search(sentence):
        sentence = " ".join([w for w in sentence.split() if not _NO_WORD.search(w)])
    return sentence.lower().encode("utf-8", "replace")


def sentences_of(text: str | None) -> list[str]:
    """The sentences of a text on one line each, without log lines and listings."""
    if not text or not text.strip():
        return []
    if _LISTING.search(text):
        text = "\n\n".join(line for line in text.split("\n") if not _LISTING.search(line))
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    return [s for s in (" ".join(x.split()) for x in _SPLIT.split(text)) if s]


def is_whole(sentence: str) -> bool:
    return bool(_WHOLE_END.search(sentence[-4:]) and _WHOLE_START.search(sentence) and len(_LETTER_WORD.findall(sentence)) >= SENTENCE_WORDS)


@functools.lru_cache(maxsize=2)
def _classifier(samples: tuple[tuple[str, str], ...]) -> Classifier:
    return Classifier(dict(samples))


def _segments(samples: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _classifier(samples)
        for b in batches:
            take, rows = [], []
            for i, found in enumerate(c.passages(b.column("text").to_pylist())):
                take += [i] * len(found)
                rows += found
            at = pa.array(take, pa.int64())
            lang, chars, lead, sure = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id").take(at), b.column("block_no").take(at), pa.array(lang, pa.string()), pa.array(chars, pa.int64()), pa.array(lead, pa.list_(pa.float32())), pa.array(sure, pa.float64())],
                names=["file_id", "block_no", "lang", "chars", "lead", "sure"],
            )

    return run


def read_samples(samples: DataFrame, limit: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """The labelled samples by language, at most ``limit`` characters of each, in order of their number.

    The cut is made in Spark, so what reaches the driver is bounded by languages times limit.
    Null texts and labels that name none of the languages are left out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("sample_no", "text")
    rows = (
        samples.select(canonical_language(F.col("lang")).alias("lang"), "sample_no", "text")
        .where("lang is not null and text is not null")
        .withColumn("upto", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("upto") <= limit)
        .groupBy("lang")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    )
    return tuple(sorted((r["lang"], r["text"]) for r in rows.collect()))


def _sure_sentences(samples: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _classifier(samples)
        for b in batches:
            rows = [(label, s) for label, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist()) for s in sentences_of(t) if len(s) >= 30]
            data = [telling(s) for _, s in rows]
            sizes = c.sizes(data)
            if len(rows):
                two = np.partition(sizes, 1, 1)[:, :2]
                ok = (two[:, 1] - two[:, 0] >= FIT_MARGIN * two[:, 1]) & (two[:, 0] - c.frame > FIT_NEW * np.array([len(d) for d in data]))
                ok &= sizes.argmin(1) == np.array([LANGUAGES.index(x) for x, _ in rows])
                rows = [r for r, k in zip(rows, ok.tolist()) if k]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], names=["lang", "text"])

    return run


def enriched(samples: tuple[tuple[str, str], ...], files: DataFrame, blocks: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[tuple[str, str], ...]:
    """The samples with sentences of labelled blocks that they already tell apart by a wide margin.

    Fitted on the ``rows`` blocks of smallest hash of their key among those whose file has a label, and of their
    sentences on those of smallest hash up to ``chars`` characters a language. Both bounds hold whatever the corpus and
    its order. A sentence is taken where label and dictionaries agree and the dictionary doesn't hold it already.
    """
    known = files.select(F.col("file_id").cast("bigint"), canonical_language(F.col("meta_language")).alias("label")).where(F.col("label").isin(*LANGUAGES)).groupBy("file_id").agg(F.min("label").alias("label"))
    keyed = blocks.where("file_id is not null and text is not null").select(F.col("file_id").cast("bigint"), "text", F.xxhash64("file_id", "block_no").alias("_h"))
    # the bound of the hash first, from keys alone; then the texts under it, which are few
    last = keyed.join(known, "file_id", "left_semi").select("_h").orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]
    have = dict(samples)
    if last is None:
        return tuple((lang, have.get(lang, "")) for lang in LANGUAGES)
    drawn = keyed.where(F.col("_h") <= F.lit(last)).join(known, "file_id").select("label", "text")
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, 0)
    taken = drawn.mapInArrow(_sure_sentences(samples), "lang string, text string").distinct().withColumn("_upto", F.sum(F.length("text")).over(w)).where(F.col("_upto") <= chars)
    new: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for r in sorted(taken.select("lang", "text").collect()):
        new[r["lang"]].append(r["text"])
    return tuple((lang, f"{have.get(lang, '')} {' '.join(new[lang])}".strip()) for lang in LANGUAGES)


def languages(files: DataFrame, blocks: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per file, per passage) languages with confidence.

    In: files (file_id, meta_language), blocks (file_id, block_no, text), samples (lang,
    sample_no, text). per file: file_id, label (the given one in one spelling, null if it says
    none), lang, confidence, chars; a row for each file in which a language was found. The
    confidence is the share of the text that is in the language times the margin by which the
    language won there, scaled to 1 for a margin of a third or more. per passage: file_id,
    block_no, lang, chars, confidence, where a block holds at least one whole
    sentence in a language other than its file's that is smaller by DEPART under it than under the file's. Null and empty texts and texts too short or
    too mixed to tell have no language. Blocks of a file_id that files lacks count as a file
    with no label; blocks of null file_id are left out.
    """
    known = enriched(read_samples(samples), files, blocks)
    texts = blocks.where("file_id is not null and text is not null").select(F.col("file_id").cast("bigint"), F.col("block_no").cast("int"), "text")
    # the texts are read once; what is found in them, a row or two a block, is written down for its three uses
    found = durable(texts.mapInArrow(_segments(known), "file_id bigint, block_no int, lang string, chars bigint, lead array<float>, sure double"))
    by_lang = found.groupBy("file_id", "lang").agg(F.sum("chars").alias("chars"), F.sum("sure").alias("sure"))
    main = (
        by_lang.groupBy("file_id")
        .agg(
            F.max(F.when(F.col("lang").isNotNull(), F.struct("chars", "sure", "lang"))).alias("top"),
            F.sum("chars").alias("all"),
        )
        .where("top is not null")
        .select(
            "file_id",
            F.col("top.lang").alias("lang"),
            F.round(F.col("top.chars") / F.col("all") * F.least(F.lit(1.0), 3 * F.col("top.sure") / F.col("top.chars")), 4).alias("confidence"),
            F.col("top.chars").alias("chars"),
        )
    )
    labels = files.select("file_id", canonical_language(F.col("meta_language")).alias("label")).dropDuplicates(["file_id"])
    per_file = main.join(labels, "file_id", "left").select("file_id", "label", "lang", "confidence", "chars")
    # sentences of other languages are few; their files' main language is joined to them alone
    whole = found.where("lead is not null and lang is not null").join(main.select("file_id", F.col("lang").alias("_main")), "file_id").where("lang <> _main")
    against = F.element_at("lead", F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("_main")).cast("int"))
    per_passage = whole.where(against >= DEPART).select("file_id", "block_no", "lang", "chars", F.round(F.least(F.lit(1.0), 3 * F.col("sure") / F.col("chars")), 4).alias("confidence"))
    return per_file, per_passage


def wrong_or_departing(files: DataFrame, blocks: DataFrame, samples: DataFrame) -> DataFrame:
    """(file_id, block_no, lang): files whose label is missing or wrong (block_no 0), and departing passages."""
    per_file, per_passage = languages(files, blocks, samples)
    labelled = per_file.join(files.select("file_id").distinct(), "file_id", "left_semi")
    wrong = labelled.where("label is null or label <> lang").select("file_id", F.lit(0).alias("block_no"), "lang")
    return wrong.unionByName(per_passage.select("file_id", "block_no", "lang")).distinct()
