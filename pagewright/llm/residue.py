"""Template residue, filler, error messages and script notices in place of a text.

A multi-pattern automaton marks the words of which such messages are made, in seven languages and by their part in a message: things
(page, server, script), faults (not found, denied, expired), verbs and negations (cannot be opened), requests (please enable, try again
later), words of filler, and words that say nothing by themselves. No whole sentence is stored. A fragment (a sentence or line) is residue
if its parts make a message, such as a thing with a fault or a request about a thing, and marked words cover most of it. A text is a case
if residue covers much of it, leaving out titles and page furniture, or if it begins otherwise, breaks off and ends in residue that still
makes a fair share of it. A template field that was never filled makes a case whatever the length, unless its sentence explains such
fields. Long reports that quote or mention a message keep a low share and are no cases. Null, empty and blank texts are none.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of messages by language and part; a star stands for any ending, a low line for a blank. Accents are left out. Numbers count as blanks.
WORDS = {
    "en": {
        "thing": "page* site* website* document* file* pdf content* server* service* browser* viewer* reader app application* connection* request* session* account* link* url address* database* gateway host proxy resource* image* preview* login password* access permission* rights javascript js script* cookie* plugin* network captcha robot* human system operation rate limit* traffic device* format* type response certificate token* client video download* font* memory disk quota desktop function* feature* address archive article* noscript security",
        "fault": "not_found not_available not_supported not_allowed not_enabled unavailable disabl* block* denied deny forbidden refus* fail* error* expir* timed_out timeout time_out invalid unsupported missing damaged corrupt* encrypted exceed* too_many too_large offline maintenance unexpected* unknown wrong broken moved deleted exist* busy interrupt* unauthori* reject* crash* bad fatal exception* overload* unreachable outdated out_of_date out_of_memory unreadable internal temporar* turned_off switched_off down restricted aborted suspended logged_out signed_out ended insufficient undefined unable lack locked lost violation traceback stack_trace",
        "verb": "load* open* display* show* shown render* find connect* read view* locat* retriev* serve served establish* resolv* respond* pars* start* execut* reach* verif* authenticat* fetch* perform* fulfil* handl* print* run runs running see continu* proceed* repair* replaced play* initiali* process* complet* access* support* decod* encod* reading writ* sav* send sent submit*",
        "not": "not no cannot can t couldn doesn didn isn won wasn never without",
        "ask": "please enabl* allow* activat* permit* turn_on switch_on turned_on switched_on reload* refresh* retry* reconnect* try_again try_later come_back check_back back_soon sign_in log_in log_on contact* updat* upgrad* install* wait* return* go_back click* accept* confirm* again later shortly moment* minutes seconds slow_down requir* need needed must administrator* webmaster settings checking solve prove start_page search_box",
        "fill": "placeholder* dummy sample_text sample_copy filler your_text_here text_goes_here goes_here insert_text coming_soon to_be_completed to_be_added to_be_announced to_be_determined to_be_written to_be_filled filled_in_later added_later follow_later will_follow tbd tba todo to_do under_construction intentionally_left_blank replace_this blah do_not_read",
        "neutral": "text copy column* layout body section* chapter* paragraph* test* example only goes",
        "void": "the a an this that these those of to in on at for by with from and or if is are was were be been being has have had it its you your we our us i they their there here as so but which when while then will would may might should do does did out up into than any all more before after until because due via only now some parts code id reference one two three five ten few several about take takes took wanted asked http https status most recent call last line",
    },
    "de": {
        "thing": "seite* webseite* website dokument* datei* inhalt* server* dienst* browser* betrachter* anwendung* verbindung* anfrage* sitzung* konto adresse* datenbank* ressource* bild* vorschau* anmeldung* passwort* zugriff* zugang berechtigung* skript* netzwerk* dateityp* zertifikat* gerat* volltext",
        "fault": "nicht_gefunden nicht_verfugbar deaktiviert* gesperrt* blockiert* verweigert* verboten fehlgeschlagen* fehler* serverfehler abgelaufen* zeituberschreitung ungultig* beschadigt* verschlusselt* uberschritten uberlastet* ausgelastet wartung* wartungsarbeiten unerwartet* unbekannt* existiert* verschoben* geloscht* unterbrochen* abgebrochen* abgelehnt* intern* veraltet* ausgefallen vorubergehend* zu_viele ausgeschaltet abgeschaltet fehlt fehlend* unzulassig* beendet",
        "verb": "geladen laden geoffnet offnen angezeigt anzeigen anzuzeigen gelesen lesen hergestellt aufgebaut dargestellt verarbeitet abgerufen aufgerufen unterstutzt* ausgefuhrt gestartet fortfahren fortzufahren",
        "not": "nicht kein* ohne",
        "ask": "bitte aktivier* erlaub* zulassen zugelassen einschalten eingeschaltet neu_laden versuch* spater erneut nochmals wieder anmelden kontaktier* wenden aktualisier* installier* warten klick* akzeptier* bestatig* benotigt* erforderlich* muss mussen sekunden minuten administrator* einstellung* augenblick",
        "fill": "platzhalter* blindtext* beispieltext* mustertext* fulltext* folgt_in_kurze wird_erganzt wird_noch in_bearbeitung noch_einzufugen bitte_ersetzen text_einfugen",
        "neutral": "text abschnitt* kapitel* berichtstext",
        "void": "der die das den dem des ein eine einen einem einer eines dies* ist sind war wurde wurden werden wird worden sein und oder von zu zum zur im in am an auf fur mit bei sie ihr* wir es um nach vor wenn damit dass kann konnen konnte hat haben ist noch nur als auch aus uber durch gesuchte* angeforderte* gewunschte* derzeit momentan aufgetreten leider etwas",
    },
    "fr": {
        "thing": "page* site* document* fichier* contenu* serveur* service* navigateur* lecteur* application* connexion* requete* session* compte lien* adresse* base_de_donnees ressource* image* apercu* mot_de_passe acces autorisation* droits script* reseau* appareil* systeme* format* certificat*",
        "fault": "introuvable* indisponible* inaccessible* desactive* bloque* refuse* interdit* echec* echoue* erreur* expire* delai depasse* invalide* endommage* chiffre* surcharge* occupe maintenance inattendue* inconnu* deplace* supprime* interrompu* rejete* interne* obsolete* temporaire* temporairement trop_de hors_ligne manquant* probleme* n_existe coupe",
        "verb": "charger charge* ouvrir ouvert* afficher affiche* lire lu trouver trouve* etablir etabli* traiter traite* prend repondu continuer executer demarrer aboutir",
        "not": "ne n pas plus aucun* impossible sans",
        "ask": "veuillez merci activer activez autoriser autorisez permettre recharger rechargez actualiser actualisez reessayer reessayez plus_tard tard nouveau patienter connecter connectez reconnecter contacter contactez installer mettre_a_jour cliquer cliquez accepter confirmer requis* necessaire* doit doivent secondes minutes administrateur parametres instants ulterieurement",
        "fill": "provisoire* texte_factice faux_texte texte_d_exemple texte_a_venir a_remplacer a_completer a_venir a_definir en_construction en_cours_de_redaction inserer",
        "neutral": "texte section chapitre paragraphe",
        "void": "le la les l un une des du de d au aux a ce cet cette ces c est sont a ete etre sera et ou en dans sur pour par avec vous votre vos nous notre il elle se s que qui dont si avant apres demande* votre code quelques suite afin avoir ont avec lors moment",
    },
    "es": {
        "thing": "pagina* sitio* documento* archivo* fichero* contenido* servidor* servicio* navegador* visor* lector aplicacion* conexion* solicitud* peticion* sesion* cuenta enlace* direccion* base_de_datos recurso* imagen* vista_previa contrasena acceso* permiso* permisos script* guiones red dispositivo* sistema* formato* certificado*",
        "fault": "no_encontrad* no_disponible indisponible desactivad* deshabilitad* bloquead* denegad* rechazad* prohibid* fallo* fallid* error* caducad* expirad* expiro agotado invalid* danad* cifrad* superad* excedid* sobrecargad* saturad* ocupad* mantenimiento inesperad* desconocid* movid* eliminad* interrumpid* intern* obsolet* temporalmente demasiad* fuera_de_servicio no_existe ha_fallado problema*",
        "verb": "cargar carga* abrir abierto* mostrar mostrarse muestra leer encontrar encontrad* establecer* procesar admite responde respondio disponible* continuar ejecutar iniciar completar visualizar ver",
        "not": "no ningun* sin imposible",
        "ask": "por_favor active activar habilite habilitar permita permitir recargue recargar actualice actualizar intente* intentelo mas_tarde nuevo espere inicie iniciar contacte instale haga_clic acepte confirme requiere* necesita* necesari* debe deben segundos minutos administrador ajustes vuelva unos_instantes",
        "fill": "provisional* texto_de_relleno relleno texto_de_ejemplo texto_definitivo por_completar por_definir proximamente en_construccion pendiente_de_redaccion insertar aqui_ira",
        "neutral": "texto seccion capitulo parrafo",
        "void": "el la los las un una unos unas de del al a en este esta estos estas es son ha han sido ser sera fue se su sus y o para por con que si lo le antes despues su solicitada* momento codigo puede pueden pudo hay cuando como",
    },
    "it": {
        "thing": "pagina* sito documento* file contenut* server servizio browser visualizzatore applicazione connessione richiesta* sessione account collegamento indirizzo database risorsa* immagine anteprima password accesso permess* autorizzazion* script rete dispositivo sistema formato",
        "fault": "non_trovat* non_disponibile indisponibile disattivat* disabilitat* bloccat* negat* vietat* fallit* errore* scadut* timeout non_valid* danneggiat* cifrat* superat* sovraccaric* occupat* manutenzione inattes* imprevist* sconosciut* spostat* eliminat* interrott* rifiutat* intern* obsolet* temporaneamente troppe non_esiste",
        "verb": "caricare caricat* aprire apert* mostrare mostrat* visualizzare visualizzat* leggere trovare stabilire elaborare supporta* rispond* continuare eseguire avviare trovat* disponibil*",
        "not": "non nessun* impossibile senza",
        "ask": "si_prega prego attiva* abilita* consentire consenti ricarica* aggiorna* riprova* riprovare piu_tardi nuovo attendere accedere accedi contattare installa* clic accetta* conferma* richiede richiest* necessari* deve devono secondi minuti amministratore impostazioni",
        "fill": "segnaposto testo_di_esempio testo_segnaposto testo_provvisorio da_completare da_definire in_costruzione prossimamente",
        "neutral": "testo sezione capitolo",
        "void": "il lo la i gli le un uno una di del della dei a al alla da in nel su per con e o che se questo questa questi e stato stata stati sono essere si suo tuo vostro prima dopo momento codice puo possono per questa",
    },
    "pt": {
        "thing": "pagina* site* documento* arquivo* ficheiro* conteudo* servidor* servico* navegador* leitor visualizador aplicativo conexao ligacao solicitacao pedido* sessao conta endereco banco_de_dados recurso* imagem senha acesso* permissao script* rede sistema formato",
        "fault": "nao_encontrad* nao_disponivel indisponivel desativad* desabilitad* bloquead* negad* recusad* proibid* falha* falhou erro* expirad* expirou esgotado invalid* danificad* corrompid* excedid* sobrecarregad* ocupad* manutencao inesperad* desconhecid* movid* excluid* removid* intern* temporariamente muitas nao_existe",
        "verb": "carregar carregad* abrir abert* exibir exibid* mostrar ler encontrar encontrad* estabelecer processar suporta responde continuar executar iniciar",
        "not": "nao nenhum* sem impossivel",
        "ask": "por_favor ative ativar habilite permita permitir recarregue atualize tente novamente mais tarde aguarde entre faca login contate instale clique aceite confirme requer necessari* deve devem segundos minutos administrador configuracoes",
        "fill": "texto_de_exemplo texto_provisorio em_construcao em_breve a_definir a completar",
        "neutral": "texto secao capitulo",
        "void": "o a os as um uma de do da dos das em no na nos nas este esta estes e sao foi foram ser sera se seu sua seus e ou para por com que antes depois momento codigo pode podem ao",
    },
    "zh": {
        "thing": "页面 网页 本页 网站 站点 文件 文档 内容 服务器 服务 浏览器 阅读器 查看器 程序 连接 请求 会话 登录 账号 链接 地址 网址 数据库 网关 资源 图片 图像 预览 密码 访问 权限 脚本 网络 系统 设备 格式 页 正文 验证码 功能 操作",
        "fault": "不存在 未找到 找不到 错误 出错 失败 拒绝 禁止 禁用 无权 超时 过期 失效 无效 损坏 加密 繁忙 维护 异常 已删除 被删除 已移动 移动 中断 不可用 不支持 过多 频繁 超过 超出 受限 关闭 未启用 缺失 未知 抱歉",
        "verb": "加载 打开 显示 读取 查看 连接 处理 响应 运行 执行 解析",
        "not": "无法 不能 未能 没有 不 未",
        "ask": "请 启用 开启 允许 打开 刷新 重新 重试 稍后 再试 等待 联系 更新 升级 安装 返回 点击 确认 需要 必须 管理员 设置 稍候 后再",
        "fill": "示例 占位 此处填写 填写 待补充 待定 待完善 敬请期待 建设中 测试文本 样例",
        "neutral": "文字 文本 内容 段落 章节",
        "void": "的 了 在 您 你 们 本 此 该 为 已 被 或 和 与 以 将 会 是 有 中 时 后 前 再 来 到 上 下 把 代码 当前 目前 暂时 浏览 并 其",
    },
}
PARTS = ("thing", "fault", "verb", "not", "ask", "fill", "neutral", "void")
THING, FAULT, VERB, NOT, ASK, FILL, NEUTRAL, VOID = (1 << i for i in range(len(PARTS)))
#: Words of the usual filler in mock Latin, and endings that most Latin words have.
LATIN = "lorem ipsum dolor amet consectetur adipiscing adipisicing elit tempor labore dolore magna aliqua minim nostrud ullamco laboris nisi ea ex irure esse cillum fugiat nulla pariatur culpa officia mollit anim id in et ut non sed ac at vel nec eu quis ante risus felis odio massa diam nibh purus arcu urna leo mi nunc sem orci pede augue porta ligula vitae auctor".split()
LATIN_WORD = re.compile(r"(?:[a-z]{2,}(?:us|um|am|em|is|it|ur|unt|ant|ent|ibus|orum|arum|que|tae|nae|rae)|" + "|".join(LATIN) + r")\Z")
#: Keys struck at random and letters in a row.
MASHED = re.compile(r"(?:asdf|qwert|foo|bar|baz|qux|quux|blah|bla|xx+)[a-z]*\Z")
#: Lines that programs write.
CODE_LINE = re.compile(r"""(?x)^\s*(?:traceback\s\(most|file\s"[^"\n]+",\sline\s\d+|at\s[\w$.<>]+\([^)\n]*\)\s*$|[a-z_.]*(?:error|exception)\b\s*[:(]|(?:warning|fatal\serror|parse\serror|notice)\s*:|.*\bon\sline\s\d+\W*$|.*\bphp\son\sline\b|caused\sby:|errno\b|segmentation\sfault)""", re.I)
STATUS = re.compile(r"(?<![\d.,])(?:[45]\d\d)(?![\d.,]*\d)")
#: Lines that stand on pages whatever they hold.
FURNITURE = re.compile(r"(?i)^\W*(?:[^|]{1,40}(?:\|[^|]{1,40})+|page \d+(?: of \d+)?|seite \d+(?: von \d+)?|página \d+(?: de \d+)?|record \d+/\d+|all rights (?:kept|reserved)|back to top|heading \d+|annex \d+|copyright.*|©.*|\W*\d*\W*)\W*$")
NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.-][A-Za-z0-9]+){0,4}"
#: What fields ask for, by language. Brackets round such words are fields.
ASKED = (
    "name names date day month year amount sum total price address street city town country postcode zip phone telephone fax email mail company client customer author title subject recipient sender signature signatory position department "
    "office number no ref reference account invoice order contract project product quantity description text content placeholder value currency user first last surname initials datum betrag anschrift adresse ort firma kunde betreff "
    "empfanger absender unterschrift nummer vorname nachname nom prenom montant societe client objet destinataire signature numero nombre apellido fecha importe direccion ciudad empresa cliente asunto destinatario firma data importo indirizzo "
    "nome valor endereco"
).split()
_ASKED = rf"(?:[A-Za-z]+[ _-]){{0,3}}(?:{'|'.join(ASKED)})(?:[ _-][A-Za-z]+){{0,2}}"
_HERE = r"(?:here|in this (?:box|field|space|line)|below|above|hier|ici|aqui|aquí|qui)"
_DO = r"(?:please )?(?:click to |tap to )?(?:type|enter|insert|write|fill in|put|add|state|give|your|choose|select|hier|bitte|insérer|saisir|indiquer|insertar|escribir|escriba|inserire|inserir)"
#: Forms of fields by a text that each of them holds.
FIELDS = tuple(
    (trigger, re.compile(form, re.I))
    for trigger, form in (
        ("{{", r"\{\{[^{}\n]{1,80}\}\}"),
        ("{%", r"\{%[^%\n]{1,80}%\}"),
        ("{", rf"(?<![\\\w{{$^_])\{{{_ASKED}\}}(?!\}})|\{{[!$]\s*{NAME}\s*\}}"),
        ("${", rf"\$\{{\s*{NAME}\s*\}}"),
        ("$", rf"(?<![\w$])\${_ASKED}\b"),
        ("[", rf"\[\[\s*{NAME}\s*\]\]|\[{_DO} [^\[\]\n]{{1,60}}\]|\[[^\[\]\n]{{1,60}} (?:to be (?:added|completed|inserted|filled in|determined)|{_HERE}|tbd|goes here)\]|\[{_ASKED}\]"),
        ("<", rf"<<\s*{NAME}\s*>>|<%=?\s*{NAME}\s*%>|<{_DO} {NAME}>|<{_ASKED}>"),
        ("(", rf"\({_DO} [^()\n]{{1,60}} {_HERE}\)|\({_DO} (?:the |your |a )?{_ASKED}\)|%\({NAME}\)[sdf]"),
        ("#", r"#[A-Za-z]+(?:_[A-Za-z0-9]+)*#"),
        ("@@", r"@@[A-Za-z0-9_]+@@"),
        ("%%", r"%%[A-Za-z][A-Za-z0-9_]*%%"),
        ("|", r"\*\|[A-Za-z][A-Za-z0-9_:]*\|\*|\|\|[A-Za-z_]+\|\|"),
        ("__", r"\b__[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*__\b"),
        ("____", r"\b[\w ]{2,20}:[ \t]*_{4,}"),
        ("«", rf"«\s*{NAME}\s*»"),
        ("［", r"［[^［］\n]{1,20}］"),
        ("姓名", r"[【\[(（](?:请?(?:填写|输入|插入))?姓名[】\])）]"),
        ("请", r"[【\[(（]请?(?:在此)?(?:填写|输入|插入)[^】\])）\n]{0,20}[】\])）]"),
    )
)
#: A numbered field, and fixed values: words and signs of sentences in which braces hold sets.
NUMBERED = re.compile(r"(?<![\\\w{$]) ?\{\d\}(?!\{)")
SETS = re.compile(r"(?i)\b(?:sub)?sets?\b|\bsingletons?\b|\blet\b|\belements?\b|\b(?:teil)?mengen?\b|\bensembles?\b|\bconjuntos?\b|\binsiem[ei]\b|\bconjuntos?\b|集合|[=∈⊂⊆∪∩∖]")
#: Phrases that explain fields where they stand before a field in its sentence, and where they follow it.
EXPLAINS = re.compile(
    r"(?i)\bfor\s+(?:instance|example)\b|\be\.\s?g\.|\bstands?\s+for\b|\bmarks?\s+(?:a|the|each|every)\s+(?:\w+\s+)?fields?\b|\b(?:double|curly)\s+(?:braces|brackets)\b|\bwritten\s+as\b|\\frac|\blet\s+[a-z]\s+="
    r"|\b(?:fields?|marks|tags|variables|tokens|placeholders?)\s+(?:such\s+as|like|named|called)\b|\b(?:a|the|each|every)\s+(?:placeholder|variable)\s*[:,]?\s*$|\b(?:template\s+syntax|the\s+syntax)\b|\b(?:shell|code|program|source)\s+listing\b"
    r"|\btemplates?\s+(?:mark|use|write|contain|hold|show|put)s?\b|\bin\s+(?:a|the|our|each|every|such\s+a|letter|mail)\s+templates?\b"
    r"|\bzum\s+beispiel\b|\bz\.\s?b\.|\b(?:platzhalter|felder|feldern|variablen)\s+(?:wie|etwa)\b|\bin\s+(?:der|einer|jeder)\s+vorlage\b|\bvorlagen?\s+(?:kennzeichn|markier|enth|schreib|verwend)\w+|\bpar\s+exemple\b|\bp\.\s?ex\.|\bchamps?\s+(?:comme|tels?\s+que)\b|\bdans\s+(?:le|un|chaque)\s+modèle\b"
    r"|\bpor\s+ejemplo\b|\bp\.\s?ej\.|\bcampos?\s+como\b|\ben\s+(?:la|una|cada)\s+plantilla\b|\blas\s+plantillas\s+(?:marcan|usan|contienen)\b|例如|比如|模板(?:中|里|用|使用)|占位符(?:如|用|为)|用[^，,]{0,12}表示"
)
EXPLAINS_AFTER = re.compile(r"(?i)\W{0,3}(?:stands?\s+for\b|is\s+an?\s+(?:variable|placeholder)\b|marks\b|steht\s+für\b|représente\b|representa\b|表示|代表)|[`’”\"']")
QUOTE = re.compile(r"[`‘“\"']\s*$")
#: Ends of sentences around a field; the dots of e.g., z.B., p.ex. and p.ej. are none.
STOP = re.compile(r"(?i)\n|[。！？]|[!?](?=\s|$)|(?<!\be)(?<!\be\.g)(?<!\be\. g)(?<!\bz)(?<!\bz\.b)(?<!\bz\. b)(?<!\bp)(?<!\bp\.ex)(?<!\bp\. ex)(?<!\bp\.ej)(?<!\bp\. ej)\.(?=\s|$)")
SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
NOT_WORD = re.compile(r"[\W\d_]+")
#: Shares: of a fragment's telling letters that are marked, of the text that is residue, and of the text that ends in residue after an opening.
FRAGMENT_SHARE, TEXT_SHARE, END_SHARE = 0.7, 0.5, 0.05
#: Latin words that make a fragment filler, as a share of its words, and how many words it needs.
LATIN_SHARE, LATIN_WORDS = 0.6, 4
ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")


@lru_cache(maxsize=2)
def automaton(void: bool = False) -> ahocorasick.Automaton:
    """All words with the parts they may play, their length and whether they may go on to the end of a longer word. Words that say nothing are in one of their own."""
    a = ahocorasick.Automaton()
    for language, parts in WORDS.items():
        for name, words in parts.items():
            if (name == "void") != void:
                continue
            for w in (x.replace("_", " ") for x in words.split()):
                bare = w.rstrip("*")
                key = bare if language == "zh" else f" {bare}" if w.endswith("*") else f" {bare} "
                before = a.get(key, (0, 0, False))[0]
                a.add_word(key, (before | 1 << PARTS.index(name), len(key), w.endswith("*")))
    a.make_automaton()
    return a


def open_field(text: str) -> str | None:
    """The first template field that its own sentence does not explain."""
    stops = explained = None
    forms = [form for trigger, form in FIELDS if trigger in text] + ([NUMBERED] if "{" in text else [])
    for m in itertools.chain.from_iterable(form.finditer(text) for form in forms):
        if stops is None:
            stops = [x.end() for x in STOP.finditer(text)]
        k = bisect.bisect_right(stops, m.start())
        begin, end = stops[k - 1] if k else 0, stops[bisect.bisect_left(stops, m.end())] if stops and stops[-1] >= m.end() else len(text)
        if explained is None:
            explained = [x.start() for x in EXPLAINS.finditer(text)]
        k = bisect.bisect_left(explained, m.start())
        before = k and explained[k - 1] >= begin or QUOTE.search(text[max(begin, m.start() - 20) : m.start()])
        before = before or m.re is NUMBERED and SETS.search(text[max(begin, m.start() - 200) : min(end, m.end() + 200)])
        if not before and not EXPLAINS_AFTER.match(text[m.end() : min(end, m.end() + 200)]):
            return m.group()
    return None


def _dense(words: str, hits: list[tuple[int, tuple[int, int, bool]]], at: int) -> bool:
    """Whether words with a part make up most of a fragment's letters beside those that say nothing. ``hits`` are the automaton's, ``at`` is where the fragment begins."""
    n, covered = len(words), bytearray(len(words) + 2)
    for end, (_, length, _) in automaton(void=True).iter(f" {words} "):
        covered[end - length + 1 : end + 1] = b"\2" * length
    covered = covered[1:-1]
    for end, (_, length, open_) in hits:
        begin, stop = max(end - length + 1 - at, 0), end + 1 - at
        if open_:
            stop = words.find(" ", stop)
            stop = n if stop < 0 else stop
        covered[begin:stop] = b"\1" * (min(stop, n) - begin)
    return covered.count(1) >= FRAGMENT_SHARE * (n - covered.count(2))


def _is_filler(text: str) -> bool:
    """Mock Latin, keys struck at random, or one word over and over."""
    if _COMMON(f" {text} "):
        return False
    words = text.split()
    n = len(words)
    if n >= 3 and 2 * len(set(words)) <= n + 1 and max(map(words.count, set(words))) >= max(3, LATIN_SHARE * n):
        return True
    if MASHED.match(words[0]) and sum(1 for w in words if MASHED.match(w)) >= LATIN_SHARE * n:
        return True
    return n >= LATIN_WORDS and 3 * len(_SURELY_LATIN(text)) >= n and sum(1 for w in words if LATIN_WORD.match(w)) >= LATIN_SHARE * n


_SURELY_LATIN = re.compile(r"(?<![^ ])(?:[a-z]+(?:us|um|[oa]rum|ibus)|" + "|".join(LATIN) + r")(?![^ ])").findall
#: Words of common speech that mock Latin lacks.
_COMMON = re.compile(" (?:the|of|and|to|was|der|die|das|und|von|mit|de|la|le|les|des|du|el|los|las|del|por|di|il|che|della|da|do|os) ").search
#: What a text with lines of programs has somewhere.
_MAY_CODE = re.compile(r"error|exception|traceback|line \d|warning|notice|errno|fault|caused by|\n\s*at [\w$]").search
#: What a text with filler has somewhere: a beginning of mashed keys, an ending or word of mock Latin, or a word twice in a row.
_MAY_FILL = re.compile(r" (?:asdf|qwert|foo|ba[rz]|qu?ux|blah?|xx)|(?:us|um|ibus|[oa]rum) |lorem|ipsum| ([^\W\d_]+) \1 ")


def _is_message(parts: int, status: bool) -> bool:
    """Whether words with these parts make a message."""
    fault = parts & FAULT or parts & NOT and parts & VERB
    return bool(fault and (parts & THING or parts & ASK or status) or parts & ASK and parts & THING or parts & FILL)


def residue_share(text: str) -> tuple[float, bool]:
    """Share of the text's letters in residue, without title and furniture, and whether the text's last paragraph is residue."""
    text = re.sub(r"-[ \t]*\n[ \t]*(?=[a-zà-ÿ])", "", text.lower()).translate(ACCENTS)
    may_code = bool(_MAY_CODE(text))
    fragments = []  # words, ends like a sentence, number of the paragraph, is code, as it stands
    for number, paragraph in enumerate(re.split(r"\n\s*\n", text)):
        for line in paragraph.split("\n"):
            if may_code and CODE_LINE.match(line):
                fragments.append((NOT_WORD.sub(" ", line).strip() or "code", True, number, True, line))
                continue
            for m in SENTENCE.finditer(line):
                raw = m.group().strip()
                words = NOT_WORD.sub(" ", raw).strip()
                if words:
                    fragments.append((words, raw[-1] in ".!?。！？", number, False, raw))
    if not fragments:
        return 0.0, False
    hay, at = " " + "  ".join(f[0] for f in fragments) + " ", 1
    hits, may_fill = list(automaton().iter(hay)), bool(_MAY_FILL.search(hay))
    judged, hit, own = [], 0, []  # letters, is residue, parts, ends like a sentence, number of the paragraph
    for words, stops, number, code, raw in fragments:
        n, parts, first = len(words), 0, hit
        while hit < len(hits) and hits[hit][0] <= at + n:
            parts |= hits[hit][1][0]
            hit += 1
        message = _is_message(parts, bool(parts & FAULT) and bool(STATUS.search(raw))) and _dense(words, hits[first:hit], at)
        judged.append((n, code or message or may_fill and _is_filler(words), parts, stops, number))
        own.append((words, raw, first, hit, at))
        at += n + 2
    if not any(j[1] for j in judged):
        return 0.0, False
    held = {j[4] for j in judged if j[1]}  # what goes on in a message's paragraph with its words belongs to it
    judged = [
        (n, residue or bool(parts) and number in held and _dense(words, hits[first:after], begin), stops, number)
        for (n, residue, parts, stops, number), (words, raw, first, after, begin) in zip(judged, own, strict=True)
        if residue or not (n < 200 and FURNITURE.match(raw))
    ]
    total = covered_letters = tail = tail_covered = 0
    for k, (n, residue, stops, number) in enumerate(judged):
        if number == judged[-1][3]:
            tail, tail_covered = tail + n, tail_covered + n * residue
        if residue:
            covered_letters += n
        elif k == 0 and len(judged) > 1 and n <= 90 and not stops:
            continue  # a title
        total += n
    ends = tail_covered >= TEXT_SHARE * tail
    return covered_letters / total if total else 0.0, ends


def judge(text: str | None) -> tuple[str, float] | None:
    """Kind and share of a case; None where the text is none."""
    if not text or not text.strip():
        return None
    if open_field(text):
        return "field", 1.0
    share, ends = residue_share(text)
    if share >= TEXT_SHARE or ends and share >= END_SHARE:
        return "message", share
    return None


def residue_cases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, share) of the cases, one row per row of ``docs`` that is one. One scan, no shuffle; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *j) for i, t in enumerate(batch.column(1).to_pylist()) if (j := judge(t))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([f[0] for f in found], pa.int32())), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())], names=[key, "kind", "share"]
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, kind string, share double")
