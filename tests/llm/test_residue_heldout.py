"""Wordings of error pages, script notices and fillers, from general knowledge of such pages.

SEEN: lists written before the phrase lists, or from which they were extended after a first look at what was missed.
FRESH: written after the phrase lists were final; of this list nothing was used, so its recall is what to expect."""

from __future__ import annotations

from quarryline.llm.residue import residue

ERRORS = [
    "502 Bad Gateway nginx", "Error establishing a database connection", "The requested URL was not found on this server.", "This site can't be reached. The connection was reset.", "Sorry, the page you were looking for could not be found.",
    "403 Forbidden. You don't have permission to access this resource.", "An error occurred while processing your request.", "Your access to this site has been limited by the site owner", "This content is not available in your region.", "Checking your browser before accessing the site.",
    "Too many redirects. This page isn't working.", "The server encountered an internal error or misconfiguration and was unable to complete your request.", "We couldn't find that page.", "Please complete the captcha to continue.", "503 Service Temporarily Unavailable", "Request timed out. Please try again.",
    "Désolé, cette page n'existe pas", "Erreur 404 : la page que vous recherchez est introuvable.", "Die Seite konnte nicht gefunden werden.", "Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.", "Lo sentimos, la página que busca no existe.", "Pagina non trovata", "Siamo spiacenti, la pagina richiesta non esiste più.",
    "Pagina niet gevonden", "Deze pagina bestaat niet meer.", "Página não encontrada", "Desculpe, ocorreu um erro. Tente novamente mais tarde.", "Nie znaleziono strony", "Strona, której szukasz, nie istnieje.", "Страница не найдена", "Доступ запрещён", "ページが見つかりません", "页面不存在", "您访问的页面找不到了",
]
NOTICES = [
    "JavaScript is required to use this site", "You need to enable JavaScript to run this app.", "Please turn on JavaScript in your browser and reload the page.", "This website works best with JavaScript enabled.", "JavaScript must be enabled in order for you to use this page.", "Your browser does not support JavaScript!",
    "It seems JavaScript is disabled in your browser", "Veuillez activer JavaScript pour utiliser ce site.", "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen.", "Debe habilitar JavaScript para utilizar este sitio", "Per utilizzare questo sito è necessario abilitare JavaScript.", "Schakel JavaScript in om deze site te gebruiken.",
    "Ative o JavaScript para continuar.", "Włącz obsługę JavaScript w przeglądarce.", "Для работы сайта необходимо включить JavaScript.", "JavaScriptを有効にしてください", "请启用JavaScript以继续使用本网站",
]
FILLERS = [
    "Insert text here", "Add your description here", "Your content goes here. Edit or remove this text inline.", "This is a sample paragraph. Replace it with your own.", "Lorem ipsum dolor sit amet, consectetur", "Type your title here", "Just another WordPress site", "Insérez votre texte ici", "Hier könnte Ihr Text stehen", "Escriba aquí su texto", "Inserisci qui il tuo testo",
]
MORE = {
    "error": [
        "This page can't load right now.", "500 Internal Server Error", "The webpage at this address might be temporarily down or it may have moved permanently.", "Hmm. We're having trouble finding that site.", "Application error: a client-side exception has occurred", "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.", "Secure Connection Failed", "Unable to connect", "Access to this page has been denied.", "Your IP address has been blocked.", "Something went wrong. Try again.", "410 Gone", "504 Gateway Time-out", "Whoops, looks like something went wrong.", "Service unavailable. Please try again in a few minutes.", "We're sorry, but this video is no longer available.", "Rate limit exceeded", "Invalid request", "Session timed out, please log in again.", "Account suspended", "This domain is parked", "Sitzung abgelaufen. Bitte melden Sie sich erneut an.", "Interner Serverfehler", "Diese Website ist derzeit nicht erreichbar.", "Zu viele Anfragen. Versuchen Sie es später noch einmal.", "Une erreur s'est produite lors du chargement de la page.", "Cette page n'est plus disponible.", "Le site est en cours de maintenance.", "Error interno del servidor", "La página a la que intenta acceder no está disponible.", "Accesso negato", "Si è verificato un errore imprevisto. Riprova più tardi.", "Er is een fout opgetreden.", "Acesso negado", "Erro interno do servidor", "Błąd wewnętrzny serwera", "Внутренняя ошибка сервера", "Сервис временно недоступен", "アクセスが拒否されました", "服务器内部错误", "Sidan kunde inte hittas", "Siden blev ikke fundet", "Stránka nenalezena", "Sayfa bulunamadı", "페이지를 찾을 수 없습니다", "No results to display because the server is offline.", "You don't have access to this page.", "The file or directory you requested is not on this server.", "This page is currently being updated.", "Server busy, retry shortly.", "The link you clicked has expired.", "Cannot GET /index.html", "HTTP Error 400. The request is badly formed.", "Sorry! This page has been moved or deleted.", "We could not process your request at this time.", "The connection to the server was interrupted.", "Access restricted to members only.", "Your request was blocked by the firewall.", "This store is unavailable", "Error 1020 Access denied", "Please log in to view this content.", "The service you requested is restricted", "Seite existiert nicht", "Der Server ist überlastet. Bitte versuchen Sie es in einigen Minuten noch einmal.", "Sie haben keine Berechtigung, diese Seite anzuzeigen.", "Vous n'avez pas l'autorisation d'accéder à cette page.", "Service temporairement indisponible", "El servidor ha tardado demasiado en responder.", "No tienes permiso para acceder a esta página.", "La pagina che stai cercando non è disponibile.", "Deze website is tijdelijk niet bereikbaar.", "O servidor está temporariamente indisponível.", "Serwis jest chwilowo niedostępny.", "Запрашиваемая страница была удалена.", "お探しのページは存在しません", "抱歉，您访问的页面已被删除", "Något gick fel, försök igen senare", "Stránka neexistuje",
    ],
    "notice": [
        "This application requires JavaScript.", "Scripts are disabled. Enable them to continue.", "For full functionality of this site it is necessary to enable JavaScript.", "Oops! Your browser has JavaScript turned off.", "We use JavaScript to show this content. Please enable it.", "noscript: please enable scripts", "Cookies and JavaScript must be enabled.", "Diese Anwendung erfordert JavaScript.", "JavaScript ist in Ihrem Browser deaktiviert.", "Ce site nécessite JavaScript pour fonctionner.", "JavaScript est désactivé dans votre navigateur.", "Este sitio requiere JavaScript.", "JavaScript está desactivado en su navegador.", "JavaScript è disattivato nel browser.", "JavaScript is vereist voor deze website.", "O JavaScript está desativado no seu navegador.", "Ta strona wymaga włączonej obsługi JavaScript.", "В вашем браузере отключен JavaScript.", "このサイトではJavaScriptを使用しています", "您的浏览器不支持JavaScript", "Aktivera JavaScript för att fortsätta", "JavaScript'i etkinleştirin", "JavaScript disabled! Please enable it and refresh.", "Turn JavaScript on to see this page.", "Our website relies on JavaScript. Activate it in your browser settings.", "Without JavaScript this page will not work.", "Enable scripts to continue", "You have JavaScript disabled", "JavaScript support is necessary for this page.", "Bitte schalten Sie JavaScript ein.", "Für diese Seite muss JavaScript aktiviert sein.", "JavaScript doit être activé pour afficher cette page.", "Vous devez activer JavaScript.", "Por favor, active JavaScript en su navegador.", "Necesita JavaScript para ver esta página.", "Abilita JavaScript per continuare.", "U moet JavaScript inschakelen.", "É necessário ativar o JavaScript.", "Proszę włączyć JavaScript.", "Пожалуйста, включите JavaScript в вашем браузере.", "JavaScriptが無効になっています", "请在浏览器中开启JavaScript",
    ],
    "filler": [
        "Your headline here", "Click here to add text", "Enter a short description", "Placeholder content", "This is some dummy text for testing purposes.", "Write something about yourself.", "Sample text", "Your logo here", "Text goes here...", "Start typing your content", "Add a caption", "Fülltext", "Geben Sie hier Ihren Text ein", "Platzhalter für den späteren Inhalt", "Ajoutez ici votre description", "Texte à remplacer", "Agregue aquí su contenido", "Texto de ejemplo", "Testo segnaposto", "Voeg hier uw tekst toe", "Insira seu texto aqui", "Wpisz tutaj swój tekst", "Введите текст здесь", "在此处输入文本", "ここにテキストを入力してください", "Insert your text here", "Your title goes here", "Replace this text with your own content.", "This is placeholder text.", "Add description here", "Type something here", "Dummy text for layout", "[Your text here]", "Hier Text einfügen", "Dies ist ein Beispieltext", "Überschrift hier eingeben", "Entrez votre texte ici", "Ceci est un texte d'exemple", "Escribe tu texto aquí", "Este es un texto de ejemplo", "Scrivi qui il tuo testo", "Typ hier uw tekst", "Escreva seu texto aqui", "Wstaw tekst tutaj", "Вставьте текст сюда", "在这里输入您的内容",
    ],
}
FRESH = {
    "error": [
        "Whoa there! This page doesn't seem to exist.", "The requested resource could not be located.", "Server error in application.", "The site is experiencing technical difficulties.", "Your session is invalid or has expired. Log in again.", "No page exists at this address.", "Database error", "Upstream connect error", "Connection timed out error code 522", "Page unavailable in your country", "Requested file was not found on the server", "You must be logged in to view this page", "Oh no, we can't find what you're looking for", "The website is under maintenance and will be back soon.", "Unauthorized: access is denied due to invalid credentials.", "Zugriff auf diese Seite wurde verweigert", "Die Verbindung wurde zurückgesetzt", "La page a été déplacée ou supprimée", "Trop de tentatives, réessayez plus tard", "La conexión ha caducado", "El sitio web está en mantenimiento", "Il server non risponde", "U heeft geen toegang tot deze pagina", "Você não tem permissão para acessar esta página", "Страница временно недоступна", "现在无法访问此网站",
    ],
    "notice": [
        "Kindly enable JavaScript to view comments.", "This page needs JavaScript to work.", "JavaScript is turned off in your web browser.", "You must have JavaScript enabled to use this form.", "Sorry, this app doesn't work without JavaScript.", "Scripts must be allowed for this site.", "Ohne JavaScript funktioniert diese Seite nicht.", "Merci d'activer JavaScript dans votre navigateur.", "Active JavaScript para ver este contenido.", "Questo sito richiede JavaScript.", "Deze site werkt niet zonder JavaScript.", "O seu navegador não suporta JavaScript.", "Strona wymaga JavaScript.", "Включите JavaScript для просмотра.", "JavaScriptを有効にする必要があります",
    ],
    "filler": [
        "Insert heading here", "Write your text here", "Put a description here", "This is a placeholder paragraph.", "Edit this text", "Subtitle goes here", "Sample title", "Your name here", "Titel hier einfügen", "Das ist ein Platzhaltertext", "Insérez un titre ici", "Ajoutez du texte ici", "Añade tu texto aquí", "Aggiungi qui una descrizione", "Plaats hier uw titel", "Digite aqui o título",
    ],
}
PROSE = [
    "Error 404 means that a page was not found, and the log lists each one.", "The script runs every night and rebuilds the index.", "Please enable the option in the settings before you start a scan.", "The page count is missing for three of the reports.", "We couldn't find the invoice in March, so the team asked the supplier.",
    "If a service is unavailable, the queue keeps the request until it returns.", "Access to the archive was denied to two users after the audit.", "The server was moved to another room and answers again.", "Our site in Lyon is open on Mondays.", "Add your files to the folder and wait for the next scan.", "The text of the contract was replaced by the lawyers.",
    "Most pages of the handbook need JavaScript only for the search box.", "Die Seite 12 des Berichts fehlt noch.", "Der Fehler trat nach dem Umzug des Servers auf.", "La page de garde du rapport porte une date.", "Le service des archives est fermé en août.", "La página doce del informe no lleva fecha.", "El servidor guarda una copia de cada carpeta.",
    "La pagina dodici del rapporto è vuota.", "De pagina met de kaart hangt in de gang.", "A página doze do relatório está vazia.", "Strona tytułowa raportu jest pusta.", "Страница двенадцать отчёта пуста.", "報告書の十二ページは空白です。", "报告的第十二页是空白的。",
    "A request to the supplier timed out twice last week, which the desk reported.", "The link between the two folders was removed by hand.", "Try the search again with fewer words.", "Team Heron has permission to read the volume.", "The connection between size and age is weak.",
]


def recall(kind: str, texts: list[str]) -> float:
    return sum(kind in residue(t)[0] for t in texts) / len(texts)


def test_recall_of_wordings_seen():
    found = {k: recall(k, ts) for k, ts in (("error", ERRORS), ("notice", NOTICES), ("filler", FILLERS))}
    assert all(r >= 0.9 for r in found.values()), found
    assert all(sum(bool(residue(t)[0]) for t in ts) >= 0.85 * len(ts) for ts in MORE.values())


def test_recall_of_fresh_wordings():
    found = {k: sum(bool(residue(t)[0]) for t in ts) for k, ts in FRESH.items()}
    assert sum(found.values()) >= 0.65 * sum(map(len, FRESH.values())), found


def test_prose_is_spared():
    assert [t for t in PROSE if residue(t)[0]] == []
