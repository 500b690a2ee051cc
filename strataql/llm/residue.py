"""Template residue, filler, error-page messages and demands for scripts where content should be.

Code (fenced, indented, in backticks) and quotations are blanked first, since a text that shows or
quotes such things is content. One automaton over phrases of several languages, each with a role,
finds the lines that may hold a message; a sentence there is one when its roles combine (a page's
noun with the failure that follows it, a word for scripts with a demand to allow them), or when a
whole phrase stands in it. What a reporting verb governs, or what hangs on a condition, doesn't count.

The decision is by coverage of the block: a line in which messages or filler hold at least
BLOCK_COVERAGE of the characters stands in the place of content; in a line of prose that mentions
them they hold less, unless the text breaks off with one. An unfilled placeholder is a block of its own, since it takes the place of a
value wherever it stands. Coverage of the whole document is given as well.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a line's characters from which messages in it stand in the place of content.
BLOCK_COVERAGE = 0.3
#: Characters between a noun and the failure that is told of it.
NEAR = 60

# Phrases by kind and role, in lower case. A leading or trailing "|" asks for a word boundary.
PHRASES: dict[tuple[str, str], list[str]] = {
    ("filler", "whole"): [
        "lorem ipsum", "text goes here", "placeholder paragraph", "placeholder text", "sample text.", "dummy text", "filler text", "body copy to follow", "copy to follow",
        "write something about this", "insert text here", "your text here", "add your content", "content coming soon", "content goes here", "description goes here", "replace this text",
        "texto de relleno", "texto de ejemplo", "escriba aquí", "texto provisional", "texte d'exemple", "texte à remplacer", "texte de remplissage", "texte provisoire", "votre texte ici",
        "dolor sit amet", "text to be added", "add a description", "enter your", "insert summary", "insert description", "insert content", "add description", "enter a description", "add text here", "add title", "click to edit", "edit this text", "write your", "enter your text", "type your text", "type something", "description of the product", "your company name", "your name here", "company name here", "to be written", "to be filled in", "to be completed", "lipsum", "this is sample", "sample content", "example text", "test test test", "asdf asdf",
        "text kommt noch", "hier könnte", "hier text", "hier eingeben", "beschreibung folgt", "wird noch ergänzt", "ajoutez une description", "saisissez votre", "à compléter", "à venir", "agregue una descripción", "añada una descripción", "escriba su", "por completar", "aggiungi una descrizione", "da completare", "adicione uma descrição", "a preencher", "добавьте описание", "введите текст", "описание будет", "添加描述", "请输入", "待补充", "説明を追加", "入力してください", "後で追加",
        "insert your text", "replace with your own text", "this is a placeholder",
        "testo segnaposto", "testo di esempio", "testo di prova", "testo da sostituire", "inserire qui il testo", "texto de preenchimento", "texto de exemplo", "texto provisório", "insira aqui", "escreva aqui",
        "здесь будет текст", "здесь должен быть текст", "текст-заполнитель", "текст-заглушка", "образец текста", "此处填写", "此处输入", "在此处添加", "在此输入", "示例文本", "占位文本", "voorbeeldtekst", "tekst volgt", "opvultekst",
        "platzhaltertext", "blindtext", "beispieltext", "mustertext", "hier steht text", "text folgt", "ここに説明を入れる", "ここにテキスト", "ダミーテキスト", "サンプルテキスト", "仮のテキスト", "ここに文章",
    ],
    ("error", "noun"): [
        "|page|", "|pages|", "|view|", "|document|", "|report|", "|resource|", "|site|", "|website|", "|service|", "|content|", "|address|", "|url|", "|backend|", "|server|", "|section|", "|sections|", "|file you|", "|link you|", "|article|", "|rule|",
        "|seite|", "|regel|", "|dokument|", "|dienst|", "|ressource|", "|inhalt|", "|adresse|", "|webseite|", "|server|", "|bericht|", "|ansicht|",
        "|règle|", "|ressource|", "|site|", "|vue|", "|rapport|", "|contenu|", "|serveur|",
        "|página|", "|regla|", "|recurso|", "|documento|", "|servicio|", "|sitio|", "|contenido|", "|informe|", "|vista|", "|servidor|",
        "|access|", "|request|", "|view|", "|link|", "|video|", "|image|", "|account|", "|connection|", "|gateway|", "|file|", "|item|", "|post|", "|product|", "|feature|", "|application|", "|app|", "|database|", "|host|", "|domain|",
        "|datei|", "|verbindung|", "|anwendung|", "|konto|", "|lien|", "|fichier|", "|connexion|", "|contenu|", "|enlace|", "|archivo|", "|conexión|", "|aplicación|", "|collegamento|", "|connessione|", "|ligação|", "|arquivo|", "|ссылка|", "|соединени", "链接", "连接", "リンク", "接続",
        "|pagina|", "|servizio|", "|sito|", "|risorsa|", "|contenuto|", "|serviço|", "|conteúdo|", "|site|", "|dienst|", "|accès|", "|accesso|", "|acesso|", "|acceso|", "|zugriff|", "|toegang|",
        "|страниц", "|сервис", "|сайт", "|ресурс", "|документ", "|сервер", "页面", "网页", "服务", "网站", "资源", "内容", "服务器",
        "ページ", "サイト", "サービス", "ルール", "文書", "コンテンツ", "サーバー",
    ],
    ("error", "failure"): [
        "could not be found", "can not be found", "cannot be found", "can't be found", "was not found", "couldn't find", "could not find", "does not exist", "doesn't exist", "no longer exists", "could not be served", "could not be loaded", "could not be displayed", "could not be shown", "could not be opened", "cannot be shown", "cannot be displayed", "cannot be loaded", "can't be shown", "can't be displayed",
        "failed to load", "is not available", "isn't available", "is unavailable", "is currently unavailable", "temporarily unavailable", "was moved or removed", "has been moved", "has been removed", "was removed", "timed out", "is gone", "is down", "is missing", "did not answer", "did not respond", "is not responding", "cannot be reached", "could not be reached", "you requested", "do not have permission", "don't have permission", "not authorized", "not allowed to see", "went wrong", "something broke",
        "can't be reached", "couldn't be reached", "no longer available", "has been shut down", "was shut down", "has been discontinued", "has been retired", "no longer here", "has been deleted", "was deleted", "may have been removed", "may have been moved", "might have been removed", "may be broken", "took too long", "has failed", "could not be established", "was refused", "was reset", "was interrupted", "isn't working", "is not working", "isn't responding", "won't load", "didn't load", "cannot be found", "is offline", "is private", "requires permission", "is closed", "is suspended", "has been suspended", "is out of order", "ran into a problem", "is currently down",
        "steht nicht zur verfügung", "nicht mehr verfügbar", "nicht hergestellt werden", "ist fehlgeschlagen", "ist abgelaufen", "existiert nicht mehr", "n'est plus en ligne", "temporairement indisponible", "a échoué", "a expiré", "introuvable", "indisponible", "no está en línea", "ha fallado", "ha caducado", "ha expirado", "ya no está", "non è più disponibile", "è scadut", "não está mais", "expirou", "falhou", "больше не существует", "больше не доступ", "не удалось", "истек", "已过期", "已失效", "失败", "超时", "已关闭", "期限が切れ", "失敗しました", "できませんでした", "削除されています",
        "can't be found", "couldn't be found", "can't be loaded", "is denied", "was denied", "is forbidden", "is restricted", "unavailable", "has expired", "not found", "has timed out", "could not be completed", "could not be processed",
        "non trovat", "non è stata trovata", "non è stato trovato", "non disponibile", "non è disponibile", "non esiste", "non risponde", "è stata rimossa", "è stato rimosso", "non può essere", "não encontrad", "não foi encontrad", "indisponível", "não está disponível", "não existe", "não responde", "foi removid", "não pode ser exibid", "negado", "negato", "refusé", "denegado", "geweigerd", "verweigert",
        "не найден", "недоступ", "не существует", "не отвечает", "удален", "запрещ", "不存在", "找不到", "未找到", "不可用", "暂时无法", "无法显示", "无法访问", "无法加载", "已被删除", "没有响应", "被拒绝", "niet gevonden", "niet beschikbaar", "niet bereikbaar", "bestaat niet",
        "nicht gefunden", "nicht angezeigt werden", "nicht geladen werden", "nicht verfügbar", "nicht erreichbar", "existiert nicht", "ist gesperrt", "antwortet nicht", "wurde verschoben", "wurde entfernt", "wurde gelöscht", "nicht vorhanden",
        "est introuvable", "est indisponible", "ne répond pas", "n'existe plus", "n'existe pas", "n'est pas disponible", "n'a pas été trouvé", "ne peut être affich", "ne peut pas être affich", "a été déplacé", "a été supprimé", "est bloquée", "est verrouillée", "n'est plus disponible",
        "no existe", "no responde", "no está disponible", "no disponible", "no se encuentra", "no se ha encontrado", "no se encontró", "no se puede mostrar", "no puede mostrarse", "ha sido eliminad", "fue eliminad", "está bloquead", "ya no existe",
        "見つかりません", "表示できません", "利用できません", "応答しません", "応答がありません", "存在しません", "アクセスできません", "読み込めません", "削除されました", "ロックされています",
    ],
    ("error", "whole"): [
        "something went wrong while", "something went wrong on our", "something broke on our side", "an unexpected error has occurred", "an unexpected error occurred", "application error:", "an exception was raised while", "traceback (most recent call last)", "your session has expired", "session has timed out", "planned maintenance", "down for maintenance", "under maintenance", "be back shortly", "too many requests from", "slow down and try again", "did not answer in time", "access denied", "permission denied to view", "you do not have permission to see", "you do not have access to this", "ask an administrator for access", "please log in to", "log in again to continue", "sign in with an account that", "you must sign in to",
        "something went wrong", "an error has occurred", "an error was encountered", "there was a problem", "there was an error", "having trouble", "we're experiencing", "internal error", "does not have permission", "sign in to see", "sign in to view", "log in to view", "request failed", "failed with status", "cannot get /", "cannot post /", "temporarily unable", "team has been notified", "no se pudo", "no se ha podido", "impossibile", "não foi possível", "n'a pas pu", "impossible de", "konnte nicht geladen", "не получилось", "加载失败", "encountered an error", "encountered an internal error", "error establishing", "unable to complete your request", "unable to connect", "unable to display", "unable to find", "unable to open", "failed to connect", "connection refused", "connection timed out", "connection reset", "fatal error:", "parse error:", "warning: mysql", "uncaught exception", "unhandled exception", "stack trace:", "page doesn't exist", "page does not exist", "page has moved", "nothing here", "nothing was found", "nothing to see here", "you need permission", "request access", "requires authentication", "please log in", "please sign in", "please contact the administrator", "contact your administrator", "contact support", "verify you are human", "checking your browser", "please try again", "please refresh", "reload this page", "not available in your country", "not available in your region", "subscribe to continue", "temporarily offline", "closed for maintenance", "rate limit exceeded", "quota exceeded", "maximum execution time", "out of memory",
        "ein fehler ist aufgetreten", "fehler aufgetreten", "unerwarteter fehler", "bitte melden sie sich an", "bitte versuchen sie es", "keine berechtigung", "wird gewartet", "erreur inattendue", "veuillez réessayer", "veuillez vous connecter", "vous n'avez pas l'autorisation", "nous n'avons pas trouvé", "error inesperado", "vuelva a intentarlo", "inténtalo de nuevo", "debe iniciar sesión", "no tiene permiso", "no hemos encontrado", "errore imprevisto", "errore interno", "non hai i permessi", "accedi per continuare", "erro inesperado", "erro interno", "faça login", "não tem permissão", "непредвиденная ошибка", "внутренняя ошибка", "ошибка сервера", "войдите, чтобы", "нет прав", "服务器错误", "内部错误", "系统错误", "请重新登录", "没有权限", "无权访问", "请求超时", "予期しないエラー", "再度お試しください", "権限がありません",
        "an error occurred", "error occurred while", "scheduled maintenance", "routine maintenance", "try again later", "try again in a few", "you don't have permission to", "you don't have access", "not authorized to view", "session has expired", "we couldn't find", "we can't find", "we could not find", "we are unable to", "we're unable to", "unable to load", "unable to process your request", "403 forbidden", "access is denied",
        "accesso negato", "pagina non trovata", "riprova più tardi", "si è verificato un errore", "sessione è scaduta", "in manutenzione", "acesso negado", "página não encontrada", "tente novamente mais tarde", "ocorreu um erro", "sessão expirou", "em manutenção", "algo deu errado", "qualcosa è andato storto",
        "доступ запрещ", "доступ закрыт", "страница не найдена", "попробуйте позже", "повторите попытку позже", "произошла ошибка", "сессия истекла", "технические работы", "访问被拒绝", "拒绝访问", "请稍后再试", "请稍后重试", "发生错误", "出错了", "登录已过期", "维护中", "toegang geweigerd", "probeer het later opnieuw", "er is een fout opgetreden", "in onderhoud",
        "zugriff verweigert", "bitte später erneut versuchen", "versuchen sie es später", "wartungsarbeiten", "ihre sitzung ist abgelaufen", "melden sie sich an, um", "es ist ein fehler aufgetreten", "seite nicht gefunden", "etwas ist schiefgelaufen",
        "accès refusé", "accès interdit", "réessayez plus tard", "connectez-vous pour", "votre session a expiré", "une erreur est survenue", "une erreur s'est produite", "en maintenance", "page introuvable", "page non trouvée",
        "acceso denegado", "inténtelo más tarde", "inténtelo de nuevo más tarde", "inicie sesión para", "su sesión ha caducado", "su sesión ha expirado", "se ha producido un error", "ha ocurrido un error", "en mantenimiento", "página no encontrada", "algo salió mal",
        "アクセスが拒否されました", "エラーが発生しました", "しばらくしてから", "ログインしてください", "セッションの有効期限が切れ", "メンテナンス中", "url をご確認ください", "urlをご確認ください", "時間をおいて",
    ],
    # A line with one of these may be a status line, or pseudo-Latin; patterns and counts decide.
    ("line", "status"): [
        "not found", "bad gateway", "internal server error", "service unavailable", "gateway timeout", "gateway time-out", "forbidden", "unauthorized", "too many requests", "bad request", "request timeout",
        "|error|", "|erreur|", "|fehler|", "|errore|", "|erro|", "ошибка", "错误", "エラー", "|oops|", "|sorry|", "|hmm|", "|unfortunately|", "|whoops|", "|uh oh|",
        "|asdf", "|sdfg", "|qwer", "|hjkl", "|jkl;", "|zxcv", "|xxx|", "|blah|", "|bla|", "|yada|", "|etc|", "|foo|",
        "|lorem|", "|ipsum|", "|dolor|", "|amet|", "|elit|", "|velit|", "|magna|", "|labore|", "|commodo|", "|fugiat|", "|nisi|", "|esse|",
    ],
    # A block of nothing else.
    ("error", "sole"): ["under construction", "coming soon", "in costruzione", "em construção", "en construction", "en construcción", "im aufbau", "on its way soon", "в разработке", "建设中", "敬请期待", "準備中", "工事中"],
    ("scripts", "noun"): ["javascript", "|js|", "|scripts|", "|scripting|", "client-side script", "script execution", "|skripte|", "|skripten|", "|los scripts|", "|les scripts|", "スクリプト", "|скрипт", "脚本"],
    # Asks for scripts to be allowed, whatever the sentence's subject.
    ("scripts", "demand"): [
        "turn on", "turned on", "turned off", "is not available", "isn't available", "is off", "are off", "are blocked", "is blocked", "was blocked", "must be on", "|activated|", "not supported", "aren't allowed", "isn't allowed", "allow them", "allow it", "turn it on", "switch on", "switched on", "switched off", "switch it on", "|enable|", "|enabled|", "|disabled|", "|blocked|", "|blocks|", "|allow|", "|allowed|", "are permitted", "be permitted", "must allow", "does not support", "doesn't support", "|activate|", "|unavailable|",
        "aktivieren", "eingeschaltet", "ausgeschaltet", "einschalten", "erlauben", "erlaubt sein", "deaktiviert", "blockiert",
        "activer", "activez", "désactivé", "bloqué", "autorise", "activé", "|active|", "activar", "habilit", "desactivado", "deshabilitado", "bloqueado", "permita",
        "abilita", "attiva", "disattivat", "|ative|", "desativad", "habilite", "включите", "отключ", "не поддерживает", "启用", "开启", "禁用", "schakel", "uitgeschakeld",
        "有効にして", "無効", "ブロックされ", "許可して", "オンにして", "有効化",
    ],
    # The same, where the sentence speaks of what is shown.
    ("scripts", "need"): [
        "is required", "are required", "is needed", "are needed", "|requires|", "|require|", "|needs|", "|need|", "wird benötigt", "erforderlich", "benötigt", "exige", "|requis|", "nécessite", "nécessaire", "se necesita", "necesita", "requiere", "necesario",
        "richiede", "necessari", "requer", "necessári", "требуется", "нужен", "需要", "vereist", "nodig", "必要です",
    ],
    ("scripts", "place"): [
        "|page|", "|pages|", "|site|", "|app|", "|application|", "|view|", "|viewer|", "|view it|", "|shown|", "|show|", "|display|", "|displayed|", "|appears|", "|browser|", "|browse|", "sign in", "log in", "|console|", "|results|", "|content|", "|continue|", "|playground|", "|website|", "|see|", "|load|",
        "|seite|", "anzeigen", "angezeigt", "|ansicht|", "|konsole|", "|browser|", "|inhalt|", "affich", "|page|", "navigateur", "|site|", "|contenu|", "|console|", "página", "navegador", "contenido", "|ver|", "mostrar", "|consola|", "|reglas|",
        "pagina", "browser", "visualizzar", "contenuto", "exibir", "conteúdo", "страниц", "браузер", "просмотр", "页面", "查看", "浏览器", "网站", "画面", "表示", "ページ", "ブラウザ",
    ],
    # Reporting verbs: what follows in their clause is what somebody said, saw or asked for.
    ("report", "verb"): [
        "|said|", "|says|", "|saw|", "|sees|", "|asked|", "|asks|", "|told|", "|reported|", "|reports|", "|complained|", "|mention|", "|mentions|", "|mentioned|", "|quoted|", "|quotes|", "|quoting|", "|reject|", "|rejects|", "|rejected|",
    ],
    # The same, but servers and pages speak so of themselves: the subject must be another one.
    ("report", "answer"): ["|returned|", "|answered|", "|meldete|", "|zeigte|", "|affichait|", "|renvoyait|", "|mostraba|", "|devolvía|", "|devolvió|", "を返し"],
    # What follows in the clause is spoken of, whatever the subject.
    ("report", "about"): ["is read as", "are read as", "is taken as", "is treated as", "has nothing to do with", "have nothing to do with"],
    # What stands right behind is named.
    ("report", "name"): ["the marker", "the banner", "the string", "the phrase", "the placeholder", "|jinja|", "names such as", "markers such as", "phrases such as", "messages such as", "strings such as", "placeholders such as"],
    # A placeholder right before is explained.
    ("report", "explained"): ["stands for", "is replaced by", "gets replaced"],
    # What comes before in the clause is quoted.
    ("report", "quotative"): ["と表示", "と報告"],
}

# Words of the usual pseudo-Latin filler.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua
    enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse
    cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum""".split()
)

#: Rows of a keyboard; runs along them are typed to fill space.
ROWS = ("qwertyuiop", "asdfghjkl;", "zxcvbnm")
# Words that stand for any text when they come one after the other.
EMPTY_WORDS = frozenset("blah bla yada etc foo bar baz qux".split())

PLACEHOLDER = re.compile(
    r"""(?=[{\[$\#<%_@&])(?:
      \{\{(?!\#|/)[^{}\n]{1,60}\}\}
    | \[\[\s?[.\w][^\[\]\n]{0,60}\]\]
    | \$\{[^{}\n]{1,60}\}
    | \#\{[^{}\n]{1,60}\}
    | <%=?[^%\n]{1,60}%>
    | \$\([A-Za-z][\w .-]{0,60}\)
    | (?<![\w{$\#%])\{[A-Za-z][A-Za-z]*(?:[_ .][A-Za-z]+){0,4}\}
    | (?:<|&lt;)(?:insert|enter|your|add)\s[\w .-]{1,60}(?:>|&gt;)
    | (?:<|&lt;)[\w .-]{1,60}\s(?:goes\s)?here(?:>|&gt;)
    | (?:<|&lt;)[a-z]+_[a-z_]+(?:>|&gt;)
    | &lt;[a-z]+[ ._][a-z_ .]+&gt;
    | %[A-Z][A-Z]+(?:[_ .][A-Z]+)*%
    | (?<!\w)__[A-Z]+(?:[_ ][A-Z]+)*__(?!\w)
    | @@[A-Z]+(?:[_ .][A-Z]+)*@@
    | \[object\ Object\]
    | \[(?:insert|enter|your|add|fill\ in|type)\s[\w .-]{1,60}\]
    | \[(?!(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|NOTE|NOTICE|TODO|FIXME|OK|PASS|FAIL|SQL|URL)\])[A-Z]{4,}(?:[_ .][A-Z]+)*\](?![(\[]|\.[\[\w])
    | \[[A-Z]{2,}(?:[_ .][A-Z]+)+\](?![(\[]|\.[\[\w])
    )""",
    re.VERBOSE | re.IGNORECASE,
)
#: Parts of the pattern above that count in capitals only.
_CAPITALS = re.compile(r"^(?:%|__|@@|\[(?!\[|(?i:object|insert|enter|your|add|fill|type)\b))")

STATUS = r"(?:not found|bad gateway|internal server error|service unavailable|gateway time-?out|forbidden|unauthorized|too many requests|bad request|request timeout)"
ERROR_LINE = re.compile(
    rf"^\W*(?:http\s*)?(?:(?:error|erreur|fehler|errore|erro|ошибка|错误|エラー)\s*)?(?:[45]\d\d)?\W*{STATUS}\W*(?:\([^)]*\)|nginx|apache|openresty|cloudflare|iis)?\W*$"
    r"|^\W*(?:http\s+)?(?:error|erreur|fehler|errore|erro|ошибка|错误|エラー)\s*:?\s*[45]\d\d\s*(?::|$)"
    rf"|^\W*(?:http\s*)?(?:error\s*)?(?:[45]\d\d\s*[-–—:|]?\s*)?(?:page\s+|file\s+)?{STATUS}\s*[:.!–—|-]"
    rf"|^\W*(?:http\s*)?[45]\d\d\s*[-–—:|]\s*(?:page\s+|file\s+)?{STATUS}\b"
    r"|^\W*(?:error|oops|sorry|hmm|unfortunately|whoops|uh oh)\s*[:,!]\s+(?:the|this|that|we|your|an?)\b.*(?:load|found|find|available|shown|removed|timed out|broke|wrong|served|opened|displayed|reached|moved)",
    re.IGNORECASE,
)
HTML_ERROR = re.compile(rf"<(?:title|h1)[^>]*>\s*(?:error\s*)?(?:[45]\d\d\b|{STATUS})", re.IGNORECASE)
JSON_ERROR = re.compile(r"""\{\s*"(?:status|code|error)"\s*:\s*(?:[45]\d\d|"[^"]+")\s*,[^{}]*"(?:error|message|status|code)"\s*:[^{}]*\}""", re.IGNORECASE)
NOSCRIPT = re.compile(r"<noscript>[^<]*\bscript[^<]*</noscript>", re.IGNORECASE)

CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|^(?: {4,}|\t)[^\n]*$", re.DOTALL | re.MULTILINE)
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」")
SENTENCE = re.compile(r"[^\n.!?。！？]+(?:[.!?。！？](?!\s|$|[^\x00-\x7f])[^\n.!?。！？]*)*[.!?。！？]*")
#: Where a clause ends, and with it what a reporting verb governs.
_CLAUSE = re.compile(r";|、|\s[–—-]\s|,?\s(?:but|however|yet|so|because|aber|doch|weil|mais|car|pero|porque)\s|,\s(?:and|und|et|y)\s")
#: What follows hangs on a condition.
_CONDITION = re.compile(
    r"(?:^|\W)(?:if|when|whenever|unless|whether|where|wherever|because|once|until|whose|every time|in case|wenn|falls|ob|weil|sobald|sofern|bevor|si|quand|lorsque|lorsqu|cuando|porque|aunque|donde|se|quando|perché|caso|enquanto|если|когда|пока|потому|als|wanneer|omdat)(?:\W|$)|如果|若|当|時|場合|もし|とき|ときに|时"
)
#: What was said of a page holds for some part, version or product only: it is a statement about the product.
_SCOPED = re.compile(r"\s+(?:on|in|for|since|until|before|with|under|as|by|from|auf|für|seit|ab|unter|bei)\s+(?!this\b|our\b|your\b|the moment|the server|that\b|some\b|diese|unser)")
_PASSIVE = re.compile(r"(?:^|\s)(?:is|are|was|were|be|been|being|gets?|got)(?:\s+(?:not|also|now|already))?\s*$")
_READER = re.compile(r"(?:^|\s)you(?:\s+\w+)?\s*$")
_LEAD = re.compile(r"[ \t]*(?:[-*>#]+ |\d+[.)] |[A-Z]: |nit: |blocking: )*", re.IGNORECASE)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    roles: dict[str, list[tuple[str, str]]] = {}
    for (kind, role), phrases in PHRASES.items():
        for phrase in phrases:
            roles.setdefault(phrase, []).append((kind, role))
    words: dict[str, list[tuple[str, str, bool, bool]]] = {}
    for phrase, found in roles.items():
        left, right = phrase.startswith("|"), phrase.endswith("|")
        words.setdefault(phrase.strip("|"), []).extend((k, r, left, right) for k, r in found)
    for word, found in words.items():
        a.add_word(word, (len(word), found))
    a.make_automaton()
    return a


def _blank(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _hits(low: str) -> list[tuple[int, int, str, str]]:
    out = []
    n = len(low)
    for last, (size, found) in _automaton().iter(low):
        start, end = last - size + 1, last + 1
        for kind, role, left, right in found:
            if left and start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            if right and end < n and (low[end].isalnum() or low[end] == "_"):
                continue
            out.append((start, end, kind, role))
    out.sort()
    return out


#: Roles that alone may make a line one with a message.
_TELLING = frozenset([("line", "status"), ("filler", "whole"), ("error", "failure"), ("error", "whole"), ("error", "sole"), ("scripts", "noun")])
def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the residue in a text; kinds: placeholder, filler, error, scripts."""
    if not text or not text.strip():
        return []
    low = _lower(text)
    hits = _hits(low)
    telling = [x for x in hits if x[2:] in _TELLING]
    # Most texts have nothing that could be a message, and go no further.
    tags = "<" in text and (HTML_ERROR.search(text) or NOSCRIPT.search(text)) or '"' in text and JSON_ERROR.search(text)
    slot = PLACEHOLDER.search(text)
    if not (telling or tags or slot):
        return []
    bare = _blank(CODE, text)
    found: list[tuple[str, int, int]] = []
    if tags:
        for kind, pattern in (("error", HTML_ERROR), ("error", JSON_ERROR), ("scripts", NOSCRIPT)):
            found += [(kind, *m.span()) for m in pattern.finditer(bare)]
    bare = _blank(QUOTED, bare)
    if bare != text:
        low = _lower(bare)
        hits = _hits(low)
        telling = [x for x in hits if x[2:] in _TELLING]
    places = {low.rfind("\n", 0, x[0]) + 1 for x in telling}
    for start in sorted(places):
        end = low.find("\n", start)
        found += _line(bare, low, start, len(low) if end < 0 else end, hits)
    if slot:
        found += _placeholders(bare, low, hits)
    return sorted(found, key=lambda x: (x[1], x[2]))


def _lower(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("’", "'").replace("\xa0", " ")


def _line(bare: str, low: str, start: int, end: int, hits: list) -> list[tuple[str, int, int]]:
    """The messages and filler of one line, where they hold enough of it."""
    h = bisect_left(hits, (start,))
    inside = hits[h : bisect_left(hits, (end,))]
    out = []
    for m in SENTENCE.finditer(bare, start, end):
        a, b = m.span()
        own = [x for x in inside if a <= x[0] and x[1] <= b]
        reported = _reported(low, a, b, own) if any(x[2] == "report" for x in own) else []
        kept = [x for x in own if not _is_reported(x[0], x[3], reported)] if reported else own
        kind = _kind(_unreported(bare, a, b, reported), low, a, b, kept)
        if kind:
            out.append((kind, a, b))
    body = bare[start:end].strip()
    covered = sum(len(bare[a:b].strip()) for _, a, b in out)
    # With the text's last sentence the content broke off there, however long the line before it is.
    breaks_off = bool(out) and not bare[out[-1][2] :].strip()
    return out if out and (breaks_off or covered >= BLOCK_COVERAGE * len(body)) else []


def _reported(low: str, start: int, end: int, hits: list) -> list[tuple[int, int, str]]:
    """(start, end, role) of the parts of a sentence that a report in it governs."""
    out = []
    for at, till, kind, role in hits:
        if kind != "report":
            continue
        left = max([start, *(m.end() for m in _CLAUSE.finditer(low, start, at))])
        after = _CLAUSE.search(low, till, end)
        right = after.start() if after else end
        if role == "quotative":
            out.append((left, at, role))
        elif role == "name":
            out.append((till, re.compile(r"[ \t'(:]*").match(low, till).end(), role))
        elif role == "explained":
            out.append((at, at, role))
        elif role == "about" or (low[till : till + 1] != "," and _has_subject(low[left:at], left, at, role, hits)):
            out.append((till, right, role) if role != "answer" or low[at:till] != "を返し" else (left, at, role))
    return out


def _has_subject(before: str, left: int, at: int, role: str, hits: list) -> bool:
    """Whether a reporting verb, with these words before it in its clause, has a subject of its own."""
    part = before.rpartition(",")[2]
    subject = part if part.strip() else before
    if not re.search(r"\w", subject) or _PASSIVE.search(subject) or _READER.search(subject):
        return False
    return role != "answer" or not any(x[2:] == ("error", "noun") and left <= x[0] < at for x in hits)


def _is_reported(at: int, role: str, reported: list) -> bool:
    """Whether a phrase at this place is governed; a name in front takes whole phrases and placeholders only."""
    return any(a <= at <= b for a, b, r in reported if r != "explained" and (r != "name" or role == "whole"))


def _unreported(bare: str, start: int, end: int, reported: list) -> str:
    for a, b, role in reported:
        if role not in ("name", "explained"):
            bare = bare[:a] + " " * (b - a) + bare[b:]
    return bare[start:end]


def _kind(sentence: str, low: str, start: int, end: int, hits: list) -> str:
    """What a sentence is, from its phrases and their places; '' for content."""
    body = sentence[_LEAD.match(sentence).end() :]
    roles = {x[2:] for x in hits}
    if ("filler", "whole") in roles or _is_latin(body) or _is_mashed(body):
        return "filler"
    if ("scripts", "noun") in roles and (("scripts", "demand") in roles and _is_asked(hits) or {("scripts", "need"), ("scripts", "place")} <= roles):
        return "scripts"
    if any(r == "whole" and k == "error" and not _CONDITION.search(low, start, at) for at, _, k, r in hits) or _failed(low, start, end, hits) or ERROR_LINE.search(body):
        return "error"
    if any(r == "sole" and till - at >= 0.5 * len(sentence.strip()) for at, till, _, r in hits):
        return "error"
    return ""


def _is_asked(hits: list) -> bool:
    """Whether a demand is there besides what names the scripts themselves."""
    return any(x[2:] == ("scripts", "demand") for x in hits)


def _failed(low: str, start: int, end: int, hits: list) -> bool:
    """Whether a page's noun has failed: the failure follows close by in its clause, or takes the noun as what follows it."""
    nouns = [x for x in hits if x[2:] == ("error", "noun")]
    for at, till, kind, role in hits:
        if (kind, role) != ("error", "failure") or _SCOPED.match(low, till, end):
            continue
        for a, b, _, _ in nouns:
            if b <= at:
                gap = low[b:at]
                if len(gap) <= NEAR and not _GAP.search(gap) and not _CONDITION.search(low, start, at):
                    return True
            elif a >= till and a - till <= 15 and not _GAP.search(low[till:a]) and not _CONDITION.search(low, start, at):
                return True
            elif a < till and b > at:
                return True  # one phrase holds both
    return False


#: What separates a noun from a failure that isn't its own.
_GAP = re.compile(r"[,;:()。、，]|\s[–—-]\s|\b(?:and|or|but|und|oder|et|ou|y|e)\b")


def _is_latin(body: str) -> bool:
    words = re.findall(r"[A-Za-z]+", body)
    known = sum(w.lower() in LATIN for w in words)
    return known >= 3 and known >= 0.6 * len(words)


def _is_mashed(body: str) -> bool:
    """Whether most words are runs along a keyboard's row, one sign over and over, or words without a meaning here."""
    words = re.findall(r"[^\W\d_]+;?", body.lower())
    typed = 0
    for w in words:
        unit = w[: len(w) // 2] if len(w) % 2 == 0 and w[: len(w) // 2] == w[len(w) // 2 :] else w
        typed += len(w) >= 3 and (len(set(w)) == 1 or w in EMPTY_WORDS or any(unit in row for row in ROWS) and (len(unit) >= 4 or ";" in unit))
    return typed >= 3 and typed >= 0.6 * len(words)


def _placeholders(bare: str, low: str, hits: list) -> list[tuple[str, int, int]]:
    out = []
    reports = [x for x in hits if x[2] == "report"]
    for m in PLACEHOLDER.finditer(bare):
        token = m.group()
        if _CAPITALS.match(token) and token != token.upper():
            continue
        if reports:
            left = max(bare.rfind("\n", 0, m.start()), bare.rfind(". ", 0, m.start())) + 1
            right = min(x for x in (bare.find("\n", m.end()), bare.find(". ", m.end()), len(bare)) if x >= 0)
            reported = _reported(low, left, right, [x for x in hits if left <= x[0] and x[1] <= right]) if any(left <= x[0] < right for x in reports) else []
            if _is_reported(m.start(), "whole", reported) or any(r == "explained" and not low[m.end() : a].strip(" \t'") and a >= m.end() for a, _, r in reported):
                continue
        out.append(("placeholder", *m.span()))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["text"]):
            found = spans(text)
            covered, at = 0, 0
            for _, s, e in found:
                covered += max(0, e - max(s, at))
                at = max(at, e)
            kinds = sorted({k for k, _, _ in found})
            rows.append((i, kinds, len(found), covered / len(text.strip()) if found else 0.0))
        yield pd.DataFrame(rows, columns=["id", "kinds", "n_spans", "coverage"])


def residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kinds (array), n_spans and coverage of every row; a row without residue has 0 spans.

    Null, empty and blank texts have none; texts are taken whole; repeated rows come out each; an
    empty table gives an empty result; further columns are ignored.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(_scan, "id long, kinds array<string>, n_spans int, coverage double")
