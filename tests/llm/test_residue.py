import numpy as np

from cuewright.llm.residue import TABLE, Index, bucket, document_frequencies, label_residue, marked, windows, words

SPEECHES = [f"The Minister for harbour number {i} has told the House about the {w} of the district, and nobody in the gallery was surprised." for i in range(40) for w in ("bridge", "ferry", "school", "price", "page", "service", "server", "record")]
RESIDUE = {
    "The Member for {{speaker}} asked about roads.": "slot", "I shall be ${party} brief.": "slot", "Sitting of [INSERT TITLE]": "slot", "%(text)s": "slot", "Item: XXXX XXXX": "slot", "said that <speaker here>": "slot",
    "404 Not Found\nPage missing.": "error", "Unhandled exception in render_page at line 332": "error", "Ein interner Fehler ist aufgetreten.": "error",
    "The bridge was closed. This site requires JavaScript. Change your settings and reload.": "script", "We use cookies. Manage choices.": "cookie", "Your session has expired. Sign in to continue reading.": "sign-in",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore": "filler", "asdf asdf asdf asdf asdf asdf": "filler", "Sample transcript. Sample transcript.": "filler",
}
SPEECH_ONLY = [
    "My constituent tried to renew a permit and was shown “error 404, page not found” for 169 days, and the school in the district was surprised.",
    "Must a pensioner really be told to enable JavaScript before claiming for the canal toll in this district of ours?",
    "I was promised a session; the session, like the cookie on that website, had expired before the House was told.",
    "A sum of $186 {as it then was} was set aside. In the Bill, leave out [lines 239 to 283]. The form asks for [sic] the name.",
    "The brochure on harbour dues was printed with the words “lorem ipsum” still on its cover, and we paid for it, in every district.",
]


#: Notices as other sites word them, by which exemplars and classes were widened.
HELD_OUT = [
    "Oops! That page can’t be found.", "Sorry, the page you are looking for no longer exists.", "Error 404: The requested URL was not found on this server.", "HTTP Error 500 - Internal Server Error", "502 Bad Gateway nginx",
    "The service is temporarily unavailable. Please try again in a few moments.", "We’re sorry, but something went wrong.", "Whoops, looks like something went wrong.", "An internal error occurred while loading the article.",
    "Access to this resource on the server is denied!", "403 Forbidden. You do not have access to this content.", "This video is no longer available.", "The server is currently down for maintenance.", "Your request timed out. Please retry.",
    "Sorry, you have been blocked", "Please verify you are a human", "Fatal error: Uncaught exception in index.php on line 12", "Traceback (most recent call last): File app.py, line 3", "The link you followed may have been moved or deleted.",
    "Die Seite konnte nicht gefunden werden.", "Fehler 404 – Seite nicht gefunden", "Ein unerwarteter Fehler ist aufgetreten.", "La page que vous cherchez est introuvable.", "Erreur 500 : erreur interne du serveur.", "Lo sentimos, la página no existe.",
    "You need to enable JavaScript to run this website.", "JavaScript must be enabled in your browser to use this application.", "This content requires JavaScript to be enabled.", "Please turn JavaScript on and reload the page.", "JavaScript is not available.",
    "Your browser is no longer supported. Please update your browser.", "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Pour afficher ce contenu, veuillez activer JavaScript.", "Active JavaScript para ver este sitio.",
    "This website uses cookies to ensure you get the best experience.", "We use cookies and similar technologies.", "By browsing this site you agree to our use of cookies.", "Cookies must be enabled to continue.", "Accept all cookies", "Cookie preferences", "Wir verwenden Cookies, um Inhalte anzuzeigen.", "Ce site utilise des cookies.",
    "Please sign in to continue.", "You must log in to see this content.", "Log in or create an account to continue reading.", "Your session expired. Please log in again.", "Subscribe now to read the full article.", "This article is for subscribers only.", "Bitte melden Sie sich an, um fortzufahren.", "Inicie sesión para ver este contenido.",
    "[Your name here]", "Your text goes here.", "Insert your content here.", "Lorem ipsum dolor sit amet, consectetur.", "Sed ut dolore magna aliqua, quis nostrud ullamco laboris.", "This is sample content.", "Placeholder paragraph, replace before publishing.", "test test test test", "blah blah blah blah blah", "Hier steht Ihr Text.", "Texte d’exemple à remplacer.", "Dear {{ first_name }},", "Hello %(username)s!",
]
#: A second list of the same use.
LAST = [
    "The file you requested was not found.", "This page isn’t available right now.", "Error 410: this document has been removed.", "Nothing was found at this location.", "Server error. Please try again.", "Service unavailable, try later.", "You don’t have permission to open this document.",
    "Too many requests. Please wait a moment and retry.", "An error occurred and the record could not be displayed.", "504 Gateway Time-out", "Connection to the server was refused.", "Unexpected error on line 20", "This site can’t be reached", "Access to this page has been blocked.",
    "Dieses Dokument ist nicht mehr verfügbar.", "Interner Serverfehler", "Zugriff auf diese Seite verweigert", "Ce document n’existe plus.", "Le service est indisponible pour le moment.", "Se ha producido un error inesperado.", "Acceso denegado a este documento.",
    "Scripts must be allowed to read this document.", "Turn on scripting in your browser settings.", "Your browser blocked JavaScript.", "JavaScript required", "Ohne JavaScript kann diese Seite nicht angezeigt werden. Bitte JavaScript aktivieren.", "JavaScript doit être activé.",
    "This page uses cookies. Accept or manage settings.", "Please accept cookies to continue.", "Reject all cookies", "Bitte akzeptieren Sie alle Cookies.",
    "Sign in to read the transcript.", "You have been logged out. Sign in again.", "Register to continue reading.", "Bitte einloggen, um weiterzulesen.", "Connectez-vous pour lire la suite.",
    "Sample paragraph text.", "Enter your text here", "This is placeholder content.", "Text to be added here.", "foo bar foo bar foo bar", "Ut enim ad minim veniam, quis nostrud exercitation.", "Título de ejemplo", "{{ article.title }}",
]
#: Written last of all and never used to better the exemplars; recall on it is what the README gives.
REPORTED = [
    "The requested document could not be retrieved.", "Not Found (404)", "Sorry, an error has occurred. Our team has been informed.", "Maintenance in progress, please come back later.", "Request blocked. Reference 18.2f3a", "Error loading page. Retry", "The archive is offline at the moment.", "Unable to connect to the database.",
    "Datei nicht gefunden.", "Der Server antwortet nicht.", "Erreur 404 – document introuvable", "Error 503: servicio no disponible",
    "JavaScript must be turned on to view this document.", "Enable scripts and reload this page.", "This application needs JavaScript.", "Bitte JavaScript im Browser aktivieren.", "Votre navigateur ne prend pas en charge JavaScript.",
    "Our site uses cookies.", "Accept cookies to view this article.", "We and our partners use cookies.", "Cookies aceptar",
    "Log in to read more.", "Please sign in or register to view this page.", "Your login has expired.", "Veuillez vous identifier pour continuer.",
    "Sample speech.", "Your remarks here", "Dummy paragraph for layout.", "lorem ipsum dolor", "<%= speech.text %>",
]
MENTIONS = [
    "The House has heard that the server of the ministry was down for three days last winter, and nobody was told.", "I accept that the record of this Government on the bridge is not one that I would sign my name to.", "We were asked to wait, and we waited, and still the ferry could not be found.",
    "On the website of the department the button for the claim said “sign in to continue”, and no one could.", "My constituent was told to enable cookies, to clear them, and then to buy another machine for the school.", "The error was mine, and I have said so to the Minister for harbour dues in this House already.",
    "Let me read the document again, since the Minister clearly cannot have opened it before the gallery did.", "The letter began with the placeholder {{name}} and the family of the fisherman kept it.", "The guide says that “{{speaker}}” is filled in by the clerks of the district.", "The {{name}} clause stands in the text and I quote it here.",
    "The text of the speech that I was to give is here on the bench, and I shall not read it.", "No page of the report, and no record of the district, tells us what the service cost.",
]


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_labels(spark):
    # Mentions are as common in speeches as notices are in residue.
    texts = SPEECHES + SPEECH_ONLY * 2 + list(RESIDUE)
    got = {r["doc_id"]: r["label"] for r in label_residue(table_of(spark, texts), "doc_id", "text").collect()}
    first = len(texts) - len(RESIDUE)
    assert {texts[i] for i in got if i < first} == set()
    assert {texts[i]: got.get(i) for i in range(first, len(texts))} == RESIDUE


def test_notices_of_other_sites_and_mentions(spark, sf):
    held_out = HELD_OUT + LAST + REPORTED
    corpus = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 600").select("text").collect()]
    texts = SPEECHES + MENTIONS * 4 + held_out + corpus
    found = {r["doc_id"] for r in label_residue(table_of(spark, texts), "doc_id", "text").collect()}
    first = len(SPEECHES) + 4 * len(MENTIONS)
    missed = [t for i, t in enumerate(held_out) if first + i not in found]
    assert {texts[i] for i in found if i < first} == set()
    assert len(missed) - sum(t in REPORTED for t in missed) <= 0.1 * len(HELD_OUT + LAST), missed
    assert sum(t in REPORTED for t in missed) <= 0.4 * len(REPORTED), missed


def test_prefix_filter_loses_nothing():
    counts = np.zeros(TABLE, dtype=np.int64)
    for t in SPEECHES + list(RESIDUE):
        counts[list({bucket(w) for w in set(words(t))})] += 1
    index = Index(counts, len(SPEECHES) + len(RESIDUE))
    everything = Index(counts, len(SPEECHES) + len(RESIDUE))
    everything.anchors = {}
    for i, (bag, _, _) in enumerate(everything.exemplars):
        for w in bag:
            everything.anchors.setdefault(w, []).append(i)
    for t in SPEECHES + SPEECH_ONLY + list(RESIDUE):
        for ws in windows(marked(t)):
            a, b = index.covered(ws), everything.covered(ws)
            # Without the filter all exemplars that share a word are tried; the same ones are contained.
            assert a == b


def test_frequencies_cover_all_rows(spark):
    counts, n = document_frequencies(table_of(spark, ["a b b", None, "", "b c " * 50_000]), "text")
    assert n == 2 and counts[bucket("b")] == 2 and counts[bucket("a")] == 1 and counts[bucket("c")] == 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  "), (None, "[INSERT TITLE]"), (5, "We use cookies."), (5, "We use cookies."), (6, "word " * 100_000 + "{{speaker}}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as `key`", "3 as bucket")
    assert sorted(map(tuple, label_residue(df, "doc_id", "text").collect()), key=str) == [(5, "cookie"), (6, "slot"), (None, "slot")]
    assert label_residue(df.limit(0), "doc_id", "text").count() == 0


def test_placeholders_of_any_length_and_over_line_breaks():
    long = "the full text of the contribution as delivered from the floor of the chamber " * 3
    for text in ("{{ speech.body | default('the full text of the contribution will appear here') }}", f"{{% include '{long}' %}}", f"<% {long} %>", f"${{{long}}}", f"#{{{long}}}",
                 f"<{long}here>", f"[INSERT {long}]", "[INSERT the full text of the contribution as delivered from the floor of the chamber]", f"[{long} to be inserted]", "{{ speech\n.body }}", "[TK the\nfull text]", "[the speech to\n  be supplied]", "<the\nspeaker\nhere>"):
        assert "\x02" in marked(f"He rose. {text} He sat."), text
    for text in ("[lines 239 to 283] to be inserted", "a {b and} c}}", "<b and here", "{{ " * 200_000, "[ to be" * 200_000):
        assert "\x02" not in marked(text), text[:40]
