"""Labelled residue exemplars.

Fixed values: notices and filler as web servers, content systems and templates
in general write them, one a line, grouped by label, numbers and names left
out. Words of one meaning are folded into classes before anything is counted
or compared, so that an exemplar stands for all its wordings.
"""

from __future__ import annotations

#: Words that mean the same in a notice; a class counts as one word.
CLASSES: dict[str, str] = {
    "object": """page pages webpage file files document documents record records article articles content contents site website url resource transcript transcripts
        reader view app application debate post posts feature video link address seite seiten webseite dokument datei protokoll debatte inhalt fichier article contenu compte rendu
        página páginas documento archivo acta contenido sitio""",
    "script": "javascript scripts script scripting js client-side",
    "enable": "enable enabled enabling activate activated turn turned switch switched allow allowed unblock aktivieren aktiviert einschalten activé activée activado aktiviere activer activez active activar activa habilite habilitar",
    "off": "disabled blocked denied refused closed verweigert refusé denegado deactivated off unsupported deaktiviert blockiert désactivé bloqué desactivado bloqueado",
    "login": "sign log login logged signed register subscribe subscriber subscribers account anmelden einloggen registrieren connecter connectez connectez-vous identifier identifiez sesión identifíquese",
    "see": "read reading view see open load loading display displayed shown show run browse browsing watch lesen laden anzeigen ansehen lire afficher voir charger leer ver abrir mostrar cargar",
    "access": "access accessing zugriff zugang accès acceso permission permissions authorized authorised berechtigung autorisation permiso",
    "server": "server archive host upstream backend service serveur servidor servicio dienst system",
    "need": "need needs require requires required must requiere necesita nécessite benötigt erfordert",
    "find": "n’existe found find locate located exist exists missing available unavailable verfügbar disponible indisponible gefunden trouvée trouvé introuvable encontrada encontrado existe existiert",
    "ask": """requested request asked looking followed wanted searching demandée demandé cherchez cherchée recherchée angeforderte angeforderten gewünschte gesuchte suchen
        solicitada solicitado buscada busca buscas""",
    "browser": "browser navigateur navegador",
    "fault": "error errors exception fault fehler serverfehler systemfehler erreur erreurs errores",
    "cookie": "cookie cookies",
    "use": "use uses using used verwenden verwendet nutzen nutzt benutzt utilisons utilise utilisent utiliza utilizamos usamos usa",
    "sorry": "oops whoops sorry unfortunately leider entschuldigung désolé désolés malheureusement sentimos lamentablemente",
    "gone": "moved deleted removed renamed expired gelöscht verschoben entfernt supprimée supprimé déplacée eliminada movida",
    "settings": "settings preferences choices options einstellungen préférences paramètres preferencias configuración",
    "put": "insert inserted add added enter type replace ersetzen einfügen eingeben insérer remplacer compléter sustituir insertar reemplazar añadir",
    "issue": "publishing publish published publication release veröffentlichung publicación",
    "accept": "accept agree consent akzeptieren zustimmen accepter acceptez aceptar acepte",
    "body": "speech remarks contribution paragraph text copy rede redebeitrag beitrag absatz texte intervention paragraphe texto intervención párrafo",
    "sample": "sample dummy placeholder example filler beispieltext blindtext platzhalter exemple ejemplo relleno",
    "waiting": "wait moment patience warten patienter espere",
    "later": "later again später erneut tard nouveau tarde nuevo",
    "try": "try retry versuchen réessayer inténtelo",
    "please": "please kindly bitte veuillez favor",
}

#: Classes of which a passage must have one to be judged by the words of a whole group.
STRONG: str = "script cookie fault access browser login sample server off"

EXEMPLARS: dict[str, str] = {
    "error": """
error
http error
http status error
status error
page not found
this page isn’t available
this page isn’t available right now
nothing was found here
nothing found at this location
not found
page missing
gone
status gone
forbidden
access denied
access forbidden
unauthorized
bad request
request timeout
method not allowed
service unavailable
service temporarily unavailable
bad gateway
gateway timeout
gateway timed out
gateway time-out
unexpected error
access to this page has been denied
too many requests
internal server error
server error
connection refused
connection timed out
something went wrong
we are sorry but something went wrong
looks like something went wrong
something went wrong on our side
something went wrong on our end
an error occurred
an error has occurred
an unexpected error has occurred
an error occurred while processing your request
we are experiencing technical difficulties
please try again later
please try again in a few minutes
retry after 0 seconds
the page you requested could not be found
the page you asked for could not be found
the page you are looking for could not be found
the page you asked for could not be opened
the page you asked for could not be loaded
we cannot find that page
we could not find the page
that page cannot be found
that page can’t be found
the page does not exist
the page does not exist on this server
this page has been moved or deleted
this page is no longer available
the page you are looking for no longer exists
the page may have been moved or deleted
this page has been removed
the server could not complete your request
the server refused your request
the server gave up on your request
the server encountered an error and could not complete your request
the server did not answer in time
the server did not answer within 0 seconds
the server took too long to respond
the server is down for maintenance
this page cannot be reached
you do not have permission to view this page
you do not have permission to access this page
you are not authorized to view this page
we noticed unusual traffic
unusual traffic from your network
please verify that you are human
confirm that you are not a robot
you have been blocked
your request has been blocked
request id
reference id
back to the home page
go to the home page
contact support
fatal error
uncaught exception
unhandled exception in at line 0
traceback most recent call last
undefined variable on line 0
warning undefined variable on line 0
syntax error on line 0
null pointer exception
error establishing a database connection
seite nicht gefunden
die seite konnte nicht gefunden werden
die angeforderte seite wurde nicht gefunden
die seite existiert nicht
ein interner fehler ist aufgetreten
es ist ein fehler aufgetreten
der zugriff wurde verweigert
zugriff verweigert
das gewünschte dokument ist nicht verfügbar
diese seite ist nicht mehr verfügbar
dieses dokument ist nicht mehr verfügbar
der dienst ist nicht verfügbar
bitte versuchen sie es später erneut
page introuvable
cette page n’existe plus
le service est indisponible pour le moment
page non trouvée
la page demandée est introuvable
la page que vous cherchez est introuvable
cette page n’existe pas
erreur interne du serveur
une erreur est survenue
accès refusé
service indisponible
veuillez réessayer plus tard
página no encontrada
la página solicitada no existe
la página que busca no existe
error interno del servidor
se ha producido un error
acceso denegado
el servicio no está disponible en este momento
compruebe la dirección
inténtelo de nuevo más tarde
""",
    "script": """
please enable javascript
please enable javascript to view this page
please turn on javascript to view this page
enable javascript in your browser
you need to enable javascript to run this app
you must allow javascript to view this page
javascript is required
javascript must be enabled
javascript doit être activé
javascript muss aktiviert sein
javascript is required for this page
this site requires javascript
this page relies on javascript
this page does not work without javascript
javascript is disabled
javascript is not available
please turn javascript on
javascript is disabled in your browser
javascript is turned off in your browser
javascript is not supported in your browser
javascript is disabled in your browser so the page cannot be displayed
your browser does not support javascript
your browser is not supported
your browser is out of date
your browser is out of date and cannot display this page
update your browser
update it or allow javascript
change your settings and reload
loading this page
loading please wait
if nothing appears javascript may be blocked
bitte aktivieren sie javascript
bitte aktivieren sie javascript um die seite zu lesen
javascript ist deaktiviert
veuillez activer javascript
veuillez activer javascript pour lire la page
bitte schalten sie javascript in ihrem browser ein
javascript est désactivé
active javascript en su navegador
active javascript en su navegador para ver la página
javascript está desactivado
""",
    "cookie": """
we use cookies
this site uses cookies
this website uses cookies to improve your experience
by continuing you accept our use of cookies
accept cookies
accept all cookies
accept all
accept to continue
accept to read this page
accept all to read this page
accept cookies to go on
reject all
manage choices
manage preferences
manage cookie settings
we use cookies and similar technologies
cookie settings
we use cookies and similar technologies
please enable cookies
enable cookies to continue
cookies are disabled in your browser
wir verwenden cookies
diese seite verwendet cookies
alle cookies akzeptieren
nous utilisons des cookies
ce site utilise des cookies
accepter tous les cookies
utilizamos cookies
aceptar todas las cookies
""",
    "sign-in": """
sign in
please sign in
sign in to continue
sign in to continue reading
log in to view this page
log in to read the rest
subscribe or log in to read the rest
subscribe to continue reading
you must be logged in to view this page
please log in to continue
already a subscriber log in
create an account to continue
your session has expired
you have been logged out
you have been logged out please sign in again
connectez-vous pour lire la suite
your session has expired please sign in again
your session has timed out
this content is for members only
this article is for subscribers only
bitte melden sie sich an
bitte anmelden um weiterzulesen
ihre sitzung ist abgelaufen
veuillez vous connecter
connectez vous pour continuer
votre session a expiré
inicie sesión para continuar
inicie sesión para ver esta página
su sesión ha caducado
""",
    "filler": """
lorem ipsum
lorem ipsum dolor sit amet consectetur adipiscing elit
sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
asdf asdf asdf
qwerty qwerty qwerty
qwer qwer qwer
xyz xyz xyz
aaa aaa aaa
abc abc abc
foo bar foo bar
blah blah blah
test test test
test test ok
text text text text
this is a test
sample text
sample body text
body text goes here
sample page
dummy text
placeholder text
this is a placeholder
this is a placeholder for the text
text goes here
your text here
your text goes here
your name here
title goes here
insert text here
add your text here
enter text here
type your text here
type the text in this box
text to follow
text to be added here
text to be confirmed
text of the speech to follow
text of the page to follow
content coming soon
page under construction
dummy text do not publish
replace this text
replace this text before release
placeholder text replace before publishing
replace with your own text
beispieltext bitte ersetzen
hier steht später der text
hier steht ihr text
hier könnte ihr text stehen
platzhalter für den text
texte provisoire
texte à venir
texte à compléter
à compléter par le service
texte d’exemple
texte d’exemple à remplacer
texte à insérer
texto de relleno
texto de ejemplo
sustituir por el texto
aquí va su texto
""",
}

#: Words beside a placeholder by which a text speaks of it instead of being left unfilled; of the second list it takes two.
MENTION: str = """
placeholder placeholders template templates tag tags token tokens variable variables marker markers syntax brackets braces literally verbatim
platzhalter klammern gabarit accolades plantilla llaves
"""
MENTION_TOGETHER: str = """
clause quote quoted text wording reads stands zitat zitiere wortlaut cite texte cito texto
"""

#: Unfilled placeholders by shape, of any length and over line breaks; each shape is a token of its own, and an exemplar of itself.
SLOTS: dict[str, str] = {
    "double braces": r"\{\{[^{}]*\}\}",
    "template tag": r"\{%[^{}%]*%\}",
    "server tag": r"<%[^<>%]*%>",
    "dollar braces": r"\$\{[^{}]*\}",
    "hash braces": r"#\{[^{}]*\}",
    "percent name": r"%\([A-Za-z_][\w.]*\)[sdifr]",
    "double brackets": r"\[\[[A-Z][A-Z0-9_. ]*\]\]",
    "at signs": r"@@[A-Za-z_][\w.]*@@",
    "underscores": r"(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*__(?![A-Za-z0-9_])",
    "percent signs": r"%[A-Z][A-Z0-9_]*%",
    "dollar signs": r"\$[A-Z][A-Z0-9_]*\$",
    "guillemets": r"«[a-z]+(?:[_.][a-z]+)*»",
    "braces": r"\{[A-Za-z_][A-Za-z0-9_.]*\}",
    "angle brackets": r"<[a-z][a-z_.\s]*\shere>",
    "insert": r"\[(?:INSERT|TK|TBC|TBD|TODO)\b[^\[\]]*\]",
    "to be inserted": r"\[[^\[\]]+\sto\s+be\s+(?:inserted|added|confirmed|supplied)\]",
    "crosses": r"\bX{3,}(?: X{3,})*\b",
}
