"""Lines by which residue.py is measured: cases and plain content.

The first set was written before its phrases were rewritten. The second was written after that and
measured once, before phrases were added for what it missed; the third likewise after the second.
README has the figures of each set's first measurement.
"""

CASES = [
    "404 - Page not found", "502 Bad Gateway nginx", "HTTP ERROR 500", "Under construction", "Hello [Your Name Here]", "Pagina non trovata", "Página não encontrada", "Страница не найдена", "页面不存在",
    "This site can't be reached", "Sorry, we couldn't find that page.", "The page you are looking for does not exist.", "Oops! Something went wrong.", "Service Temporarily Unavailable", "500 Internal Server Error",
    "An error occurred while processing your request.", "Your session has timed out, please log in again.", "We are currently performing scheduled maintenance.", "Access to this resource is denied.", "403 Forbidden - you don't have access",
    "Please enable JavaScript to continue.", "You need to enable JavaScript to run this app.", "Your browser does not support JavaScript.", "This page requires JavaScript.", "Abilita JavaScript per visualizzare questa pagina.",
    "Ative o JavaScript para ver esta página.", "Включите JavaScript, чтобы просмотреть страницу.", "请启用 JavaScript 以查看此页面。", "Schakel JavaScript in om deze pagina te bekijken.",
    "Dear {{first_name}},", "Welcome, %USERNAME%!", "Order number: ${order.id}", "<Insert company name here>", "Your text here", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Testo segnaposto da sostituire.",
    "Texto de preenchimento, substituir depois.", "Здесь будет текст.", "此处填写内容", "Coming soon", "Il servizio non è disponibile.", "O serviço está indisponível.", "Сервис временно недоступен.", "服务暂时不可用，请稍后再试。", "Accesso negato", "Acesso negado",
    "Доступ запрещён", "访问被拒绝", "Bad request (400)", "Too many requests. Please try again later.",
]
CONTENT = [
    "If a table does not exist, the service returns NULL.", "Migration scripts must be reviewed.", "The rule is not available on MySQL 5.6.", "Deployment scripts are required for every release.", "When the page could not be found, the crawler stores a marker.",
    "The column was removed in version 3 of the report.", "A query that timed out is retried twice.", "The linter flags SELECT * in views.", "Use {} to initialise an empty map.", "The server was moved to another rack in May.", "We log 404 responses by path.",
    "Enable the rule in the settings file.", "JavaScript files are skipped by the extractor.", "The script requires Python 3.11.", "Filler rows are added so that pages stay aligned.", "The documentation says that access is denied for guests.",
    "Error handling belongs into the CATCH block.", "The template engine replaces placeholders such as {{name}}.", "An index on created_at is missing.", "The view no longer exists in the new schema, so drop the grant.", "Rows whose parent does not exist are reported.",
    "Set log_level to ERROR to see them.", "The website team owns these tables.", "Maintenance windows are listed in the calendar.", "The file you need is in the tools folder.", "Arrays are written as [A, B, C].", "The job failed because the disk was full.",
    "Die Regel prüft, ob eine Spalte nicht vorhanden ist.", "La regla avisa cuando un índice no existe.", "La colonne n'existe pas dans la table d'origine.", "索引不存在时查询会变慢。", "Если таблица не найдена, запрос завершается ошибкой.", "Se la tabella non esiste, la query fallisce.",
    "O índice não existe na tabela antiga.", "The service is described on the next page.", "Sign in attempts are stored in audit_log.", "Too many joins make the plan hard to read.", "Something changed in the plan between the two runs.", "The construction of the index takes an hour.", "It is soon to be released.",
]

# The second set.
LATER_CASES = [
    "We're sorry, but the requested URL was not found on this server.", "The server encountered an internal error and was unable to complete your request.", "Error establishing a database connection", "This content is no longer available.",
    "The link you followed may be broken, or the page may have been removed.", "You need permission to view this document.", "Please log in to continue reading.", "This video is unavailable in your country.", "Gateway timeout: the upstream server took too long.",
    "JavaScript is not available.", "For full functionality of this site it is necessary to enable JavaScript.", "Scripts are blocked. Allow them for this site and reload.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Diese Seite existiert nicht mehr.",
    "Ein unerwarteter Fehler ist aufgetreten.", "Désolé, cette page n'existe pas.", "Le service est temporairement indisponible.", "Lo sentimos, esta página no existe.", "Ha ocurrido un error inesperado.", "Necesitas activar JavaScript para usar esta aplicación.",
    "Spiacenti, la pagina richiesta non esiste.", "Desculpe, esta página não existe.", "К сожалению, эта страница не существует.", "抱歉，您访问的页面不存在。", "申し訳ありませんが、このページは存在しません。", "Sehr geehrte/r {{ anrede }} {{ nachname }},", "Price: {price} EUR", "[INSERT DATE]", "Add a description here.", "Text kommt noch.",
]
LATER_CONTENT = [
    "A foreign key makes sure that the parent row exists.", "The error table keeps one row per failed import.", "Pages are numbered from 1 in the printed report.", "Use NOT FOUND handlers to leave the loop.", "The server time is stored in UTC.", "Disable the trigger before the load and enable it again afterwards.",
    "The script that loads the table runs at night.", "Requests are grouped by status code, 404 and 500 among them.", "The document store was moved to cheaper disks.", "Access to the table is granted by role.", "Temporary tables are unavailable in read-only sessions.", "The index can't be used because the column is cast.",
    "Ask the owner when a view is missing from the list.", "The report shows which pages failed to load last week.", "A session that has expired is deleted by the job.", "Il rapporto elenca le tabelle senza chiave.", "El servicio guarda los errores en una tabla.", "Die Seite mit den Regeln ist sortiert.", "La page des règles est triée par nom.", "服务每天检查所有索引。",
    "Сервис проверяет все таблицы ночью.", "Square brackets such as [id] quote names.", "Format strings like %s and %d are kept.", "The value <null> marks a missing entry.", "Lorem is the name of the test schema.", "The maintenance job rebuilds indexes.", "Try the query again with a smaller range.", "Scripts in the tools folder are checked too.", "The application reads the view once an hour.", "Unexpected errors are logged with their statement.",
]

# The third set.
LAST_CASES = [
    "Sorry, there was a problem loading this page.", "We're having trouble connecting to the server.", "The document you requested could not be located.", "Page unavailable", "Internal error. Our team has been notified.", "Your account does not have permission to open this report.",
    "Sign in to see this page.", "This service has been shut down.", "Request failed with status code 500", "Cannot GET /rules/17", "Whoops, looks like something went wrong.", "The website is temporarily unable to service your request.", "Error 1020: Access denied", "No results could be loaded. Retry.",
    "JavaScript must be enabled in order to view this site.", "It looks like JavaScript is turned off.", "Dieser Inhalt ist nicht verfügbar.", "Die angeforderte Seite konnte nicht geladen werden.", "Page introuvable : vérifiez l'adresse.", "La page demandée n'est plus disponible.", "No se pudo cargar el contenido.", "El sitio está en mantenimiento.",
    "Impossibile caricare la pagina.", "Não foi possível carregar a página.", "Не удалось загрузить страницу.", "页面加载失败", "ページを読み込めませんでした。", "Hi {name}, your order {order_id} has shipped.", "TODO: insert summary here", "Enter your description here",
]
LAST_CONTENT = [
    "The page size is set by a parameter.", "Lookups by email fail when the index is missing.", "Our retry loop covers requests that failed with a timeout.", "The access path changes after the statistics are refreshed.", "Each report lists the views it reads.", "Rows are not found by a scan that skips deleted ones.", "The loader reads the file and writes a table.",
    "A server restart clears the plan cache.", "Error codes are documented in the appendix.", "The content of the column is compressed.", "This rule is off by default.", "You can enable the check per project.", "Some services read the table directly.", "The view was renamed last year.", "Users asked for a page with all rules.", "The request log is partitioned by day.", "An address without a city is kept.",
    "Scripts must not use SELECT *.", "The site plan has four tables.", "A connection pool keeps ten sessions open.", "Der Dienst liest jede Nacht alle Tabellen.", "Le serveur garde les plans en mémoire.", "La página de resultados está ordenada por fecha.", "O serviço grava um registro por linha.", "Il sito usa due database.", "该服务读取所有表。", "Страница отчёта обновляется ночью.", "ページ分割には OFFSET を使います。", "The name in brackets, [total], is an alias.", "Use {0} and {1} in the format string.",
]
