"""Words that error pages, script notices and fillers are made of, by language.

Such texts have few things to say and many ways to say them, so words are listed by what they are for, and a
segment counts by which of them it has and how little else:

error: a `thing` that can fail and a `fault`, or an `outcry`, which says both.
notice: a word of `script` and one that `demands` it.
filler: what to `put`, a `piece` of text, and where (`place`).

`talk` is what any of them may have around it. '(a|b)' stands for either, '(a|)' for a or nothing.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

SCRIPT = "javascript|java script|scripts|scripting|자바스크립트|자바스크립트를|자바스크립트가"
WORDS = {
    "en": {
        "thing": "(web |)(page|pages|site|sites)|website|websites|url|link|address|resource|content|server|gateway|service|connection|request|session|database|domain|captcha|browser|video|account|ip address|ip|application|app|data|information|document|article|post|product|host|network|results|network connection|item|profile|user|store|shop|directory|folder|area|section|feature|api|endpoint|token|form|download|image|stream|game|forum|group|channel|security|firewall|members|rights",
        "fault": "(not|cannot be|can't be|could not be|couldn't be|can not be) (found|reached|loaded|displayed|opened)|(can't|cannot|couldn't|could not|unable to) (find|reach|load|connect|complete|be found)|(does not|doesn't|no longer|does no longer) (exist|exists)|(not|no longer|isn't|is not|currently|temporarily) (available|working|responding)|unavailable|(has|have) (been |)(removed|moved|deleted|expired|limited|blocked|denied)|timed out|expired|took too long|refused to connect|refused|was reset|is down|under maintenance|forbidden|(not|don't) have permission|permission denied|unauthorized|not allowed|(has|have) been limited|encountered an (internal |)error|internal error|misconfiguration|too many (requests|redirects)|bad gateway|bad request|gateway timeout|went wrong|isn't working|(not|can't|cannot|couldn't|won't|failed to|fails to) (load|connect|open|respond|start|be (loaded|reached|opened|displayed|processed|completed))|having trouble (finding|loading|connecting|reaching)|(is|be|might be|may be) (temporarily |currently |)(down|offline|unavailable|suspended|parked|for sale|busy|overloaded)|(has |have |)(been |)(suspended|disabled|banned|restricted|terminated|removed|taken down|redirected|rejected)|moved (permanently|temporarily)|had its name changed|exceeded|invalid|suspended|offline|gone|failed|too busy|denied|is parked|refused|closed the connection|unreachable|unexpected|outdated|no longer supported|not (authorized|authorised|valid|secure|permitted|private)|(don't|do not|doesn't|not) have (access|permission|permissions|the rights|sufficient (rights|permissions))|(is|are) not (on|at|in) (this|our|the) (server|site|address)|(is|are|was|were) (currently |temporarily |)(being updated|interrupted|blocked|restricted|reset|closed|terminated|denied|removed|moved|deleted|disabled|limited|forbidden)|(been |)(moved or deleted|deleted or moved|removed or renamed|renamed or removed|deleted)|(badly|incorrectly) formed|(cannot|can't|couldn't|could not|unable to|failed to) (be |)(process|processed|handle|complete|serve|get|access|retrieve|fetch|resolve|verify|establish|show|display|respond|locate|located)|only (available )(to|for) (members|subscribers|registered users)|restricted to (members|subscribers|registered users)|requires (a login|authentication|you to log in)|(has|have) expired|has ended|busy|not responding",
        "outcry": "an (unexpected |unknown |internal |)error (has |)occurred|error establishing a database connection|checking your browser|complete the captcha|verify (that |)you are (a |)human|(enable|checking if the) (cookies|site connection is secure)|access (is |)denied|bad gateway|(service|server) (temporarily |)unavailable|(page|file|site) not found|attention required|just a moment|we'll be back (soon|shortly)|coming soon|under construction|(unable|failed|failure) to (connect|load|load page|open page)|(secure |)connection (failed|refused|timed out|lost|reset|closed)|rate limit exceeded|(invalid|bad|malformed) request|(account|user|domain|site|website) (suspended|blocked|expired)|this domain (is|has) (parked|expired|for sale)|# gone|gateway time-out|(application|server|network|database|internal server|runtime|fatal|unexpected) error|(something|looks like something|we think something) went wrong|you (have been|are|were) (blocked|banned|logged out|offline|not logged in)|no internet( connection|)|nothing (was |)found|we lost that page|maintenance mode|(temporarily|currently) (down|offline|closed) for maintenance|method not allowed|request (timeout|blocked|denied|rejected)|payment required|unsupported media type|dns error|proxy error|cannot (get|post) /|server (busy|overloaded|offline|unreachable|not responding)|(please |)(log|sign) in to (view|continue|see|access)( this (page|content|site)| this)|access (is |was |)(restricted|blocked|forbidden|limited|not allowed)|blocked by (the|our|a) (firewall|administrator|security policy|network)|you (don't|do not) have (access|permission)|page (has |)(moved|expired|removed|deleted)|not authori[sz]ed|authentication (required|failed)|(invalid|expired) (link|token|url|session)|our (servers are|server is) (busy|down|overloaded)",
        "talk": "the|this|that|it|you|your|we|our|a|an|to|for|of|on|in|at|by|is|was|are|were|has|have|had|been|be|may|might|or|and|but|please|sorry|oops|we're|you're|looking|requested|trying|tried|reach|visit|visiting|access|accessing|view|continue|proceed|open|while|before|after|processing|complete|again|later|try|refresh|reload|go|back|home|homepage|check|spelling|contact|administrator|support|owner|if|problem|persists|error|code|status|http|nginx|apache|cloudflare|port|ray id|id|#|don't|do|not|can|will|region|country|location|moment|minutes|few|use|using|run|app|application|with|without|works|best|order|features|full|experience|fully|functionality|properly|some|must|need|should|from|unable|owner|now|right|hmm|having|like|its|had|name|changed|client-side|exception|that|because|whoops|during|loading|display|show|there|there's|was a problem|problem|issue|technical difficulties|difficulties|experiencing|unexpected|moved|requests|ago|soon|been|so|no|any|all|more|information|details|please|contact us|us|let us know|know|help|team|working|fix|fixing|it's|isn't|i|what|why|when|where|which|might|maybe|perhaps|find|search|searching|instead|other|another|something|anything|nothing|hosted|web|as|you've|we've|been|does|did|doesn't|didn't|log in|sign in|login|first|necessary|supporting|browser's|settings|these|fine|better|properly|correctly|interactive|highly|strongly|recommended|experience|client|side|certain|clicked|followed|entered|typed|shortly|retry|only|time|this time|able|once|one|such|named|called|under|using|type|method|reason|because of|security|high|traffic|heavy|load|many|visitors|users|members|seconds|hours|tomorrow|minute|firewall|policy|network|wrong|mistyped|outdated|bookmark|incorrect|following|reasons|simply|either|return|start|explore|browse|popular|pages|latest|menu|top|navigation|index.html|www",
        "demand": "required|requires|require|needs|need|(turn|turned|switch|switched) (on|off)|enable|enabled|enabling|activate|activated|allow|disabled|deactivated|not supported|(does not|doesn't) support|blocked|blocking|blocks|seems|appears|must be|without|unsupported|activating|permit|permitted|necessary|(turning|switching) on|not (enabled|available|running|allowed|active)|need to|must have|relies on|depends on|off|disabled|prevents|missing|support|supported|enable it|heavy",
        "put": "insert|add|type|enter|write|put|place|paste|replace|edit|change|click to (edit|add)|remove|delete|goes|go|sample|example|dummy|placeholder|default|another|your|click here to (add|edit)|start (typing|writing)|tap to (add|edit)|drag|drop|choose|describe|tell|test|some|fill in|fill|write something|lorem|this is|type|dummy|say",
        "piece": "text|title|headline|heading|subheading|description|content|paragraph|caption|copy|body|bio|quote|wordpress site|subtitle|sentence|logo|tagline|slogan|company name|product name|button text|label|message|words|story|about yourself|item|image caption|body text|link text|intro|introduction|summary|something",
        "place": "here|inline|with your own|your own|this is|just|for testing( purposes|)|dummy|placeholder|sample|goes here|to be (added|replaced|written|filled in|completed)|in this (space|section|area|block)|example|later|coming soon|tbd|to follow|for (the |)(layout|design|demo|website|template)",
    },
    "de": {
        "thing": "(diese|die|der|die angeforderte|die gesuchte|) (seite|webseite|website|url|adresse|server|verbindung|dienst|inhalt|link)|datenbankverbindung|anfrage|sitzung|(diese|die|) (anwendung|app|website|internetseite|verbindung)|(der|dieser|) (artikel|account|zugang|browser)|konto|daten|anmeldung",
        "fault": "(konnte|kann|wurde|wurden|konnten|) (leider |)nicht (gefunden|geladen|erreicht|geöffnet|verarbeitet|hergestellt)( werden|)|existiert (leider |)nicht( mehr|)|gibt es (leider |)nicht( mehr|)|nicht (mehr |)(verfügbar|erreichbar|vorhanden)|abgelaufen|verweigert|gesperrt|überlastet|wurde (entfernt|gelöscht|verschoben)|keine berechtigung|fehlgeschlagen|(ist|sind) (derzeit|momentan|zurzeit|aktuell|vorübergehend|) (nicht erreichbar|nicht verfügbar|offline|überlastet|gestört|gesperrt)|unterbrochen|getrennt|ungültig|nicht (gefunden|erlaubt|unterstützt|möglich)|wurde (gesperrt|unterbrochen|beendet|abgelehnt)|existiert nicht|zeitüberschreitung|nicht geladen werden|keine (berechtigung|zugriffsrechte|rechte)|nicht (berechtigt|befugt|autorisiert|aufgerufen|angezeigt)( werden|)|(ist|sind|wurde|wurden) (gesperrt|abgelaufen|umgezogen|gelöscht|entfernt|verschoben|deaktiviert)|zu lange gedauert",
        "outcry": "(es ist |)ein (unerwarteter |interner |unbekannter |)fehler( ist|) aufgetreten|(seite|datei) nicht gefunden|zugriff verweigert|interner serverfehler|bestätigen sie(,|) dass sie (ein mensch|kein roboter) sind|(etwas|da) ist (etwas |)schief ?gelaufen|keine (internet|)verbindung|verbindung (fehlgeschlagen|unterbrochen|verweigert)|wartungsarbeiten|(die |)(seite|website) wird (gerade |)gewartet|sie (wurden|sind) (gesperrt|abgemeldet)|serverfehler|ungültige anfrage",
        "talk": "bitte|versuchen|sie|es|später|erneut|noch einmal|nochmal|entschuldigung|leider|hoppla|tut uns leid|uns|zurück|zur|startseite|ihr|ihre|ihrem|ihren|in|im|um|zu|zum|diese|dieser|die|der|das|den|dem|von|fehler|fehlercode|#|oder|und|die von ihnen|gesuchte|angeforderte|aufgerufene|laden|neu|seite|webseite|website|browser|nutzen|verwenden|anzuzeigen|können|korrekt|richtig|fortzufahren|ist|wird|werden|funktioniert|ohne|mit|vollständig|darzustellen|derzeit|momentan|vorübergehend|gerade|wegen|aufgrund|wir|arbeiten|daran|kontaktieren|administrator|support|melden|an|erneut|anmelden|bei|auf|dem|eine|einen|ein|einer|haben|hat|nicht|nur|sein|muss|müssen|funktionen|alle|dieses|inhalte|inhalt|anwendung|einigen|minuten|diese seite|anzuzeigen|anzusehen|aufzurufen|wieder|da|gleich|bald|schalten|ein|muss|bitten|geduld|wurde|aufgerufene|ihrer|anfrage|nach|über|haben sie|wenden|kundendienst",
        "demand": "aktivieren|aktiviert|einschalten|eingeschaltet|erlauben|zulassen|benötigt|benötigen|erfordert|erforderlich|deaktiviert|ausgeschaltet|blockiert|unterstützt|nötig|notwendig|voraussetzung|eingeschränkt|benötigt wird|abgeschaltet|nicht (aktiviert|unterstützt|verfügbar)|ermöglichen|freigeben|schalten|muss (aktiviert|eingeschaltet) sein|einzuschalten",
        "put": "einfügen|eingeben|schreiben|ersetzen|bearbeiten|könnte|steht|stehen|fügen|geben|kommt|geben|eintragen|tippen|klicken|ihren|ihr|dein|deinen|einzusetzen|einzufügen|folgt|muster|dies ist|das ist",
        "piece": "text|titel|überschrift|beschreibung|inhalt|absatz|fließtext|textes|namen|untertitel|logo|bildunterschrift|slogan|beispieltext|mustertext|blindtext|platzhaltertext",
        "place": "hier|ein|platzhalter|beispiel|später|fülltext|muster|beispieltext|dies ist|mustertext",
    },
    "fr": {
        "thing": "(cette|la|le|ce|) (page|site|site web|url|adresse|lien|serveur|service|contenu|connexion)|session|requête|(cette|l'|votre|) ?(application|article|compte|navigateur)|données|domaine",
        "fault": "(n'existe|n'existent) (pas|plus)|(n'a|n'ont) pas (pu être |été |)(trouvée|trouvé|chargée|chargé|affichée)|(est |)(introuvable|indisponible|inaccessible)|(n'est|n'est plus|n'est pas) (disponible|accessible|autorisé|autorisée)|(a été |)(supprimée|supprimé|déplacée|déplacé)|a expiré|expirée|refusé|interdit|interrompu|(n'est|ne peut|ne peuvent) (plus|pas) (disponible|être (affichée|trouvée|chargée|atteinte)|accessible|joignable|valide)|en (cours de |)maintenance|hors ligne|momentanément indisponible|échoué|invalide|suspendu|bloqué|interrompue|perdue|pas (trouvé|trouvée|valide)|trop (longtemps|de temps)|(n'avez|n'a|sans) (pas |)(l'autorisation|accès|les droits|la permission)|temporairement (indisponible|inaccessible)|(est|sont|a été|ont été) (supprimée|supprimé|déplacée|déplacé|fermé|bloquée|suspendue)|ne répond (pas|plus)|mis trop de temps",
        "outcry": "une erreur( inattendue| interne|) (est survenue|s'est produite)|page (introuvable|non trouvée|inexistante)|accès (refusé|interdit)|erreur interne( du serveur|)|erreur de connexion à la base de données|(un problème|une erreur)( inattendu| technique|) (est survenu|s'est produit|est survenue|s'est produite)|quelque chose s'est mal passé|connexion (impossible|refusée|perdue)|erreur (serveur|réseau|interne)|requête invalide|vous avez été bloqué",
        "talk": "désolé|désolés|oups|nous|sommes|vous|votre|que|la|le|les|de|du|des|un|une|ou|et|est|a|à|ce|cet|cette|pour|dans|sur|page|site|recherchez|recherchée|cherchez|demandée|demandé|erreur|#|veuillez|réessayer|réessayez|plus tard|retour|accueil|l'accueil|utiliser|afficher|continuer|voir|navigateur|votre navigateur|pas|correctement|fonctionner|fonctionne|accéder|recharger|rechargez|lors|chargement|en cours|actuellement|momentanément|avec|par|votre|vos|notre|nos|équipe|l'url|vérifiez|contactez|administrateur|plus|trop|avez|été|être|qui|quelques|minutes|instants|au|aux|se|s'est|il|elle|on|ne|n'est|la page|de la page|afin|bon|fonctionnement|fonctionnalités|toutes|l'application|contenu|temporairement|d'accéder|accéder|n'avez|l'autorisation|devez|activer|quelques instants|bientôt|revenez|raison|suivant|rechercher|le|ici",
        "demand": "activer|activez|activé|autoriser|autorisez|désactivé|requis|nécessaire|nécessite|exige|bloqué|bloque|supporte|prend pas en charge|désactivée|désactivés|nécessitent|requiert|indispensable|obligatoire|pas activé|ne supporte pas|ne prend pas en charge|bloque|devez activer|à activer",
        "put": "insérez|insérer|ajoutez|ajouter|saisissez|écrivez|tapez|remplacez|modifiez|placez|entrez|remplacer|compléter|cliquez|votre|exemple|modifier|rédigez|faux|personnalisez|ceci est|voici",
        "piece": "texte|titre|description|contenu|paragraphe|légende|nom|logo|slogan|sous-titre|textes",
        "place": "ici|provisoire|exemple|ici même|à remplacer|à compléter|de remplissage|d'exemple",
    },
    "es": {
        "thing": "(la|esta|el|este|) (página|pagina|sitio|sitio web|url|dirección|enlace|servidor|servicio|contenido|conexión)|sesión|solicitud|(la|su|esta|) (aplicación|cuenta|red|navegador|dominio)|datos|artículo|servicio",
        "fault": "(ya |)no (existe|existen)|no (se ha podido|se pudo|se puede|pudo ser|ha sido|fue|se ha) (encontrar|encontrado|encontrada|cargar|mostrar|acceder)|no (se encuentra|se encontró|encontrada|encontrado|está disponible|disponible|responde)|(ha sido |fue |)(eliminada|eliminado|movida|movido)|ha (caducado|expirado)|denegado|prohibido|no (está|se encuentra|es) (disponible|accesible|válida|válido|permitido)|(está |)en mantenimiento|fuera de servicio|no (carga|funciona|válida|se ha encontrado|pudo cargarse|se pudo (cargar|completar|conectar))|suspendida|bloqueado|inválida|falló|agotado|interrumpida|demasiado tiempo|no (tiene|tienes) (permiso|acceso|permisos|autorización)|ha tardado (demasiado|mucho)|(tardó|tarda) demasiado|(ha sido|fue|está|están) (eliminada|eliminado|bloqueada|bloqueado|cerrada|movida)|temporalmente (no disponible|fuera de servicio)",
        "outcry": "(se ha producido|se produjo|ha ocurrido|ocurrió) un error( inesperado| interno|)|página no (encontrada|disponible)|acceso (denegado|prohibido)|error interno( del servidor|)|error al establecer (una |)conexión con la base de datos|algo (salió|ha salido|fue) mal|error (del servidor|de red|de conexión|inesperado)|conexión (rechazada|perdida|fallida)|solicitud (incorrecta|inválida)|(ha|usted ha) sido bloqueado|sin conexión( a internet|)",
        "talk": "lo sentimos|lo siento|disculpe|que|la|el|los|las|de|del|un|una|o|y|es|está|en|para|por favor|su|tu|busca|buscas|buscando|solicitada|solicitado|intente|inténtelo|inténtalo|más tarde|de nuevo|nuevamente|volver|inicio|error|#|utilizar|usar|ver|continuar|este|esta|sitio|página|navegador|correctamente|funciona|funcionar|acceder|recargue|intenta|acceder|temporalmente|actualmente|momento|minutos|unos|con|al|a|se|le|no|si|cargar|nuestro|equipo|contacte|administrador|todas|funciones|funcionalidades|contenido|poder|aplicación|cookies|ha|sido|son|tarde|responder|demasiado|acceder|permiso|tiene|tienes|pronto|vuelva|vuelve|estamos|trabajando|momentos|favor",
        "demand": "habilitar|habilite|habilita|activar|active|activa|permitir|permita|deshabilitado|desactivado|necesario|necesita|requiere|requerido|debe|bloquea|bloqueado|no soporta|no admite|desactivada|deshabilitada|requieren|imprescindible|obligatorio|activado|habilitado|soporta|compatible",
        "put": "inserte|insertar|inserta|añada|añade|agregue|agrega|escriba|escribe|introduzca|introduce|reemplace|edite|ponga|ejemplo|escribir|haga clic|sustituya|su|tu|relleno|añadir|este es|esto es",
        "piece": "texto|título|descripción|contenido|párrafo|nombre|subtítulo|logotipo|lema|mensaje",
        "place": "aquí|de ejemplo|de relleno|provisional|de prueba",
    },
    "it": {
        "thing": "(la|questa|il|questo|) (pagina|sito|sito web|url|indirizzo|server|servizio|contenuto|connessione)|sessione|richiesta|(la|l'|questa|) ?(applicazione|account|browser|rete|dominio|articolo)|dati",
        "fault": "non (trovata|trovato|esiste|esiste più|disponibile|è disponibile|è più disponibile|è stata trovata|è stato trovato|è raggiungibile|risponde)|(è stata |è stato |)(rimossa|spostata|eliminata|rimosso|spostato)|scaduta|negato|vietato|non (è (più |)(accessibile|valida|valido|consentito)|può essere (visualizzata|trovata|caricata)|funziona|valida|riuscita)|in manutenzione|fuori servizio|temporaneamente non disponibile|sospeso|bloccato|interrotta|fallita|non (hai|ha) (i permessi|il permesso|accesso|autorizzazione)|(è|sono) (stata |stato |)(rimossa|bloccata|sospesa|chiusa|scaduta)|troppo tempo",
        "outcry": "(si è verificato|si è verificato un|c'è stato un) (errore|errore imprevisto|errore interno)|pagina non (trovata|disponibile)|accesso (negato|vietato)|errore (interno |)del server|qualcosa è andato storto|(errore|problema) (di rete|di connessione|interno|imprevisto)|connessione (rifiutata|persa|fallita)|sei stato bloccato|richiesta non valida",
        "talk": "siamo spiacenti|spiacenti|ci dispiace|la|il|che|di|del|un|una|o|e|è|in|per|su|nel|tuo|suo|stai cercando|cercavi|cercata|richiesta|richiesto|errore|#|riprova|riprovare|più tardi|torna|alla|home|questo|questa|sito|pagina|browser|utilizzare|usare|visualizzare|continuare|correttamente|funziona|si prega di|prego|ricarica|imprevisto|al momento|momento|temporaneamente|con|da|dal|a|al|i|le|gli|non|se|nostro|assistenza|contatta|amministratore|tutte|funzioni|funzionalità|contenuto|applicazione|poter|minuti|qualche|tra|fra|sul|dei|delle|rispondere|tornare|presto|accedere|permesso|impiegato",
        "demand": "abilitare|abilita|abilitato|attivare|attiva|attivato|consentire|disabilitato|disattivato|necessario|richiede|richiesto|bloccato|non supporta|disabilitata|disattivata|richiedono|indispensabile|obbligatorio|abilitati|supporta|necessita|necessaria|attivi",
        "put": "inserisci|inserire|aggiungi|aggiungere|scrivi|scrivere|sostituisci|modifica|digita|segnaposto|esempio|clicca|tuo|inserimento|provvisorio|di prova|questo è",
        "piece": "testo|titolo|descrizione|contenuto|paragrafo|nome|sottotitolo|logo|messaggio",
        "place": "qui|segnaposto|di esempio|provvisorio|di prova",
    },
    "nl": {
        "thing": "(de|deze|het|dit|) (pagina|site|website|url|adres|link|server|dienst|inhoud|verbinding)|sessie|aanvraag|(deze|uw|) (applicatie|app|account|browser|netwerk)|gegevens|artikel",
        "fault": "niet (gevonden|beschikbaar|bereikbaar|geladen|toegestaan)|(kon|kan|kunnen) niet (worden |)(gevonden|geladen|geopend)( worden|)|bestaat niet( meer|)|(is |)(verwijderd|verplaatst|verlopen)|geweigerd|geblokkeerd|(is|zijn) (tijdelijk |momenteel |)(niet beschikbaar|offline|onbereikbaar)|in onderhoud|mislukt|ongeldig|niet (geldig|mogelijk)|verbroken|geen (toegang|toestemming|rechten)|(is|zijn) (verwijderd|verplaatst|geblokkeerd|gesloten|verlopen)|te lang",
        "outcry": "er is (een |iets )(onverwachte |interne |)(fout|misgegaan|fout gegaan|fout opgetreden)( opgetreden|)|pagina niet gevonden|toegang (geweigerd|verboden)|interne serverfout|er ging iets mis|er is iets (fout|mis) ?gegaan|geen (internet|)verbinding|ongeldig verzoek|serverfout|u bent geblokkeerd",
        "talk": "sorry|helaas|oeps|de|het|een|die|dat|u|je|uw|jouw|we|naar|zoekt|zocht|op zoek|bent|opgevraagde|is|was|van|in|om|te|op|of|en|deze|dit|site|pagina|website|browser|fout|#|probeer|opnieuw|later|terug|startpagina|gebruiken|bekijken|gaan|verder|goed|werkt|nodig|alstublieft|momenteel|tijdelijk|fout|opgetreden|voor|met|bij|niet|kan|kunt|alle|functies|deze|applicatie|moet|worden|onze|contact|neem|beheerder|over|enkele|minuten|hebben|heeft|er|zijn|moment",
        "demand": "schakel|ingeschakeld|inschakelen|activeer|activeren|uitgeschakeld|vereist|vereisen|nodig|toestaan|sta|geblokkeerd|ondersteunt|staat uit|uit|aan|vereiste|verplicht|ondersteunt niet|aanzetten|zet|gebruik",
        "put": "voeg|vul|voer|typ|schrijf|plaats|vervang|zet|hier|uw|je|invoeren|toevoegen|bewerk|voorbeeld|klik",
        "piece": "tekst|titel|beschrijving|inhoud|alinea|naam|koptekst|ondertitel|bericht",
        "place": "hier|toe|in|voorbeeldtekst|opvultekst",
    },
    "pt": {
        "thing": "(a|esta|o|este|) (página|site|url|endereço|link|servidor|serviço|conteúdo|conexão|ligação)|sessão|solicitação|(a|este|seu|) (aplicativo|aplicação|conta|rede|navegador|domínio|artigo)|dados",
        "fault": "não (encontrada|encontrado|existe|existe mais|está disponível|disponível|foi encontrada|foi encontrado|pôde ser encontrada|responde)|(foi |)(removida|movida|excluída|removido)|expirou|expirada|negado|proibido|não (pode ser (exibida|carregada|encontrada)|é válida|carregou|funciona|existe|permitido)|em manutenção|fora do ar|temporariamente indisponível|indisponível|suspensa|bloqueado|falhou|inválida|interrompida|não (tem|possui) (permissão|acesso|autorização)|(foi|está|foram) (removida|bloqueada|suspensa|fechada|excluída)|demorou (muito|demais)",
        "outcry": "(ocorreu|aconteceu) um erro( inesperado| interno|)|página não (encontrada|disponível)|acesso (negado|proibido)|erro interno( do servidor|)|algo deu errado|erro (de rede|de conexão|inesperado|interno)|conexão (recusada|perdida)|requisição inválida|você foi bloqueado|sem conexão",
        "talk": "desculpe|lamentamos|a|o|que|de|do|da|um|uma|ou|e|é|está|em|no|na|para|por favor|seu|sua|você|procura|procurando|solicitada|solicitado|tente|novamente|mais tarde|voltar|início|erro|#|este|esta|site|página|navegador|usar|utilizar|ver|continuar|corretamente|funciona|recarregue|temporariamente|momento|no momento|com|ao|aos|se|não|mais|tarde|as|os|nosso|equipe|contate|administrador|todos|recursos|funcionalidades|conteúdo|aplicativo|minutos|alguns|pode|poder|desta|deste|tentar",
        "demand": "ative|ativar|ativado|habilite|habilitar|habilitado|permita|permitir|desativado|desabilitado|necessário|requer|exige|precisa|bloqueado|não suporta|desativada|desabilitada|requerem|obrigatório|suporta|habilitados|necessita",
        "put": "insira|inserir|adicione|adicionar|escreva|digite|substitua|edite|coloque|exemplo|seu|sua|escrever|clique|preencha|marcador",
        "piece": "texto|título|descrição|conteúdo|parágrafo|nome|subtítulo|logotipo|mensagem",
        "place": "aqui|de exemplo|provisório|de preenchimento",
    },
    "pl": {
        "thing": "strona|strony|stronę|witryna|witryny|serwer|adres|usługa|połączenie|sesja|zawartość|aplikacja|aplikacji|konto|przeglądarka|żądanie|sieć|dane|serwis|portal|artykuł|plik",
        "fault": "nie (istnieje|znaleziono|została znaleziona|została odnaleziona|jest dostępna|jest dostępny|odpowiada)|(została |)(usunięta|przeniesiona)|wygasła|niedostępna|niedostępny|zabroniony|nie (można (znaleźć|otworzyć|wyświetlić|załadować)|działa|powiodło się)|(jest |)(tymczasowo |chwilowo |)niedostępn(a|y|e)|zablokowan(a|y|e)|w trakcie konserwacji|nieprawidłowe|utracono|nie masz (uprawnień|dostępu)|(jest|są) (chwilowo|tymczasowo) (niedostępny|niedostępna|niedostępne)|zbyt długo",
        "outcry": "(wystąpił|wystąpił nieoczekiwany|wystąpił wewnętrzny) błąd( serwera|)|nie znaleziono (strony|pliku)|strona nie (została znaleziona|istnieje)|(odmowa dostępu|dostęp zabroniony|brak dostępu)|coś poszło nie tak|błąd (wewnętrzny |sieci|)(serwera|połączenia)|błąd wewnętrzny( serwera|)|przerwa techniczna|brak połączenia",
        "talk": "przepraszamy|niestety|ups|której|którą|szukasz|szukana|żądana|ta|tej|tę|w|na|do|z|o|i|lub|aby|proszę|spróbuj|ponownie|później|wróć|główną|błąd|#|strona|strony|stronę|witryny|przeglądarce|przeglądarki|twoja|twojej|swojej|obsługę|obsługa|korzystać|kontynuować|działa|poprawnie|jest|tymczasowo|chwilowo|obecnie|możesz|prosimy|się|że|nie|swój|być|wszystkie|funkcje|treści|administratorem|skontaktuj|kilka|minut|za|dla|tego|tą|aplikacji|zobaczyć",
        "demand": "włącz|włączyć|włączona|włączony|wymaga|wymagana|wymagany|wyłączona|wyłączony|zezwól|obsługuje|wymagane|włączonej|włączenia|włączone|wyłączone|zablokowany|aktywuj|potrzebna",
        "put": "wstaw|wpisz|dodaj|wprowadź|zastąp|przykładowy|przykładowa|swój|napisz|edytuj",
        "piece": "tekst|tytuł|opis|treść|nagłówek",
        "place": "tutaj|tu",
    },
    "ru": {
        "thing": "страница|страницы|страницу|сайт|сайта|сервер|адрес|сервис|соединение|сессия|ссылка|приложение|приложения|аккаунт|учётная запись|браузер|запрос|сеть|данные",
        "fault": "не (найдена|найден|найдено|существует|доступна|доступен|отвечает)|(была |был |)(удалена|удален|удалён|перемещена)|недоступна|недоступен|истекла|истек|запрещен|запрещён|(временно |)(недоступен|недоступна|недоступно|не работает)|не (удалось|удаётся|удается) (загрузить|открыть|подключиться|найти)|заблокирован|заблокирована|прервано|на обслуживании|неверный|нет (доступа|прав|разрешения)|(была|был) (перемещена|заблокирована|удалена)|слишком (долго|много)",
        "outcry": "(произошла|возникла) (непредвиденная |внутренняя |)ошибка|страница не (найдена|существует)|доступ (запрещен|запрещён|закрыт)|внутренняя ошибка сервера|ошибка (сервера|доступа)|что-то пошло не так|ошибка (сети|соединения|базы данных)|технические работы|нет (подключения|соединения)( к интернету|)|ведутся технические работы|неверный запрос",
        "talk": "извините|к сожалению|запрашиваемая|запрошенная|которую|вы|ищете|эта|этот|на|в|с|и|или|для|пожалуйста|попробуйте|повторите|позже|еще раз|ещё раз|вернуться|главную|ошибка|#|страница|страницы|сайта|сайт|вашем|ваш|браузере|браузер|работы|просмотра|использования|этого|продолжения|корректной|необходимо|нужно|правильной|временно|сейчас|в данный момент|данный|момент|из-за|к|по|от|вас|ваш|у|мы|наш|это|все|функции|несколько|минут|через|обратитесь|администратору|можете|для|попробуйте|приложения|того|чтобы|продолжить|просмотреть",
        "demand": "включите|включить|включен|включён|отключен|отключён|выключен|требуется|необходим|необходимо|разрешите|поддерживает|нужен|отключена|отключены|включена|требует|обязателен|включения|не поддерживает|активируйте",
        "put": "вставьте|введите|добавьте|напишите|замените|введите|ваш|пример|замените|напишите",
        "piece": "текст|заголовок|описание|содержание|название",
        "place": "здесь|сюда",
    },
    "ja": {
        "thing": "ページ|サイト|サーバー|サーバ|リンク|url|接続|サービス|アプリ|アプリケーション|データ|アカウント|ネットワーク|コンテンツ",
        "fault": "見つかりません(でした|)|見つかりませんでした|存在しません|ございません|ありません|利用できません|表示できません|アクセスできません|削除されました|移動しました|期限切れ|応答していません|できません(でした|)|失敗しました|拒否されました|中断されました|停止されています|無効です|切れました|表示されません",
        "outcry": "エラーが発生しました|アクセスが拒否されました|ページが見つかりません(でした|)|メンテナンス中です|しばらくしてから(もう一度|再度)お試しください|問題が発生しました|アクセス(権限がありません|できません)|サーバーエラー|内部(サーバー|)エラー|接続できません(でした|)|タイムアウト(しました|)",
        "talk": "申し訳(ありません|ございません)(が|)|お探しの|指定された|要求された|この|その|が|は|を|に|の|で|も|へ|と|または|現在|は現在|ブラウザ|ブラウザー|設定|ため|ために|使用|利用|ご利用|表示|する|には|して|ください|エラー|#|トップ|戻る|続行|お使い|この|では|には|から|より|後で|もう一度|再度|やり直して|時間|おいて|しばらく|お|ご|ました|ます|です|い|た|し|か|機能|すべて|お使いの|内容|閲覧|いただく|いただき|下さい|お願いします|し|ている|お探し",
        "demand": "有効|無効|必要|オン|オフ|許可|対応していません|必要です|使用しています|有効化|無効になっています|オフになっています|ご利用ください|設定してください",
        "put": "入力|挿入|追加|記入",
        "piece": "テキスト|タイトル|説明|本文|文章|見出し",
        "place": "ここ",
    },
    "zh": {
        "thing": "页面|網頁|网页|頁面|网站|網站|服务器|伺服器|链接|連結|地址|网址|应用|账户|账号|数据|网络|内容|資源|资源",
        "fault": "不存在|找不到|未找到|无法(找到|访问|打开|显示|连接)|無法(找到|訪問|開啟|顯示)|已(被|)(删除|移除|过期|下线)|不可用|拒绝|没有权限|(无法|不能)(加载|使用|连接|显示)|(连接|请求|会话)(超时|失败|已过期)|已(关闭|停用|封禁|暂停)|超时|失败|无效|被拒绝|维护中",
        "outcry": "(页面|网页|頁面|文件)(不存在|找不到|未找到|无法访问)|访问(被拒绝|受限|被禁止)|(发生|出现)(了|)(未知|)错误|服务器(内部|)错误|系统(繁忙|维护中)|(服务|网站)(暂时不可用|正在维护|维护中)|出错了|出了(点|一些|)问题|网络(错误|异常)|内部服务器错误|权限不足|禁止访问|请求过于频繁",
        "talk": "抱歉|对不起|很抱歉|您|你|的|了|所|要|请|請|请求|访问|訪問|查找|浏览|本|此|该|这个|或|和|并|以|来|在|中|已|被|稍后|重试|再试|返回|首页|错误|#|使用|继续|繼續|浏览器|瀏覽器|正常|查看|网站|页面|功能|才能|可以|需要|暂时|目前|当前|由于|我们|一下|后|再|次|几分钟|联系|管理员|全部|功能|查看|内容|本页|页|站|网|为了|请您|这|那|有|不|是|与|及|将|会|能",
        "demand": "启用|啟用|开启|開啟|打开|允许|允許|禁用|停用|不支持|需要|关闭|不支持|已禁用|被禁用|未启用|已关闭|才能|支持",
        "put": "输入|輸入|插入|添加|填写|替换|请输入|示例|在此",
        "piece": "文本|文字|标题|標題|描述|内容|正文",
        "place": "此处|這裡|这里|在此",
    },
    "sv": {
        "thing": "(sidan|webbplatsen|servern|adressen|tjänsten|länken)", "fault": "(kunde |kan |)inte (hittas|hittades|visas|nås|laddas)( tyvärr|)|finns inte( längre|)|otillgänglig|nekad",
        "outcry": "sidan (hittades inte|finns inte|kunde inte hittas)|ett (oväntat |)fel (inträffade|har inträffat|uppstod)|åtkomst nekad|internt serverfel|något gick fel|serverfel|ingen (internet|)anslutning", "talk": "tyvärr|den|du|söker|sökte|försök|igen|senare|till|startsidan|för|att|i|din|webbläsare|fortsätta|använda|denna|sida|måste|och|är|se|webbplats",
        "demand": "aktivera|aktiverat|aktiveras|slå på|avstängt|kräver|krävs|inaktiverat", "put": "skriv|lägg till|infoga|ange", "piece": "text|rubrik|beskrivning", "place": "här",
    },
    "da": {
        "thing": "(siden|serveren|adressen|tjenesten|websitet)", "fault": "(blev |kunne |kan |)ikke (fundet|findes|vises)|findes ikke( længere|)|utilgængelig|nægtet",
        "outcry": "siden (blev ikke fundet|findes ikke|kunne ikke findes)|(der opstod |der er sket |)en (uventet |)fejl( opstod|)|adgang nægtet|noget gik galt|serverfejl|ingen forbindelse", "talk": "beklager|desværre|den|du|leder|efter|prøv|igen|senere|til|forsiden|for|at|i|din|browser|fortsætte|bruge|denne|side|skal|og|er",
        "demand": "aktiver|aktiveret|aktivere|slå|til|kræver|deaktiveret", "put": "skriv|tilføj|indsæt", "piece": "tekst|overskrift|beskrivelse", "place": "her",
    },
    "cs": {
        "thing": "stránka|server|adresa|služba", "fault": "(nebyla |)nenalezena|neexistuje|není (dostupná|k dispozici)|nedostupná|nebyla nalezena", "outcry": "stránka (nenalezena|nebyla nalezena|neexistuje)|(došlo k|nastala) (neočekávané |)(chybě|chyba)|přístup odepřen|chyba serveru",
        "talk": "omlouváme|se|bohužel|kterou|hledáte|zkuste|to|znovu|později|na|v|pro|prosím|tuto|této|stránku|stránky|prohlížeči|vašem|zobrazení|použití|je|nutné|zpět", "demand": "povolte|zapněte|povolit|zapnutý|vyžaduje|vypnutý", "put": "vložte|zadejte|napište", "piece": "text|nadpis|popis", "place": "zde|sem",
    },
    "tr": {
        "thing": "sayfa|site|sunucu|adres|bağlantı", "fault": "bulunamadı|bulunamıyor|mevcut değil|kullanılamıyor|engellendi|reddedildi", "outcry": "sayfa bulunamadı|bir hata oluştu|erişim (engellendi|reddedildi)|sunucu hatası",
        "talk": "üzgünüz|aradığınız|lütfen|tekrar|deneyin|daha sonra|ana|sayfaya|dön|bu|siteyi|kullanmak|için|devam|etmek|tarayıcınızda|ve|bir|'i|i", "demand": "etkinleştirin|etkinleştir|açın|gerekli|gerektirir|devre dışı", "put": "yazın|ekleyin|girin", "piece": "metin|metninizi|başlık|açıklama", "place": "buraya",
    },
    "ko": {
        "thing": "페이지|페이지를|페이지가|사이트|서버|주소", "fault": "찾을 수 없습니다|존재하지 않습니다|사용할 수 없습니다|거부되었습니다|연결할 수 없습니다|삭제되었습니다", "outcry": "오류가 발생했습니다|접근이 거부되었습니다|서버 오류|(점검 중입니다)",
        "talk": "죄송합니다|요청하신|요청한|찾으시는|이|를|을|이용하려면|사용하려면|나중에|다시|시도해|주세요|주십시오|브라우저에서|브라우저|이 사이트를|계속하려면|홈으로|자바스크립트를|자바스크립트가", "demand": "활성화|활성화해|활성화하세요|필요합니다|비활성화되어 있습니다|허용해", "put": "입력하세요|추가하세요|입력", "piece": "텍스트를|제목을|설명을|내용을", "place": "여기에|이곳에",
    },
}
_GROUP = re.compile(r"\(([^()]*)\)")


def expand(pattern: str) -> set[str]:
    """All wordings of a pattern with groups of alternatives."""
    parts = _GROUP.split(pattern)
    choices = [p.split("|") if i % 2 else [p] for i, p in enumerate(parts)]
    return {" ".join("".join(c).split()) for c in product(*choices)}


@lru_cache(maxsize=1)
def wordings() -> dict[str, frozenset[str]]:
    """(what for) -> wordings, with the kinds of all languages together: 'thing', 'fault', ..."""
    out: dict[str, set[str]] = {"script": set(SCRIPT.split("|"))}
    for kinds in WORDS.values():
        for kind, patterns in kinds.items():
            for p in re.split(r"\|(?![^()]*\))", patterns):
                out.setdefault(kind, set()).update(w for w in expand(p) if w)
    return {k: frozenset(v) for k, v in out.items()}
