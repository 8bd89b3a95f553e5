"""Default prompt texts. Every prompt operator takes a template of its own
instead; a template names its fields in braces, as ``str.format`` does."""

EXTRACT_SYSTEM = "Je haalt entiteiten, hun klassen en hun onderlinge relaties uit tekst."
EXTRACT_HUMAN = """Vat de tekst samen, noem de entiteiten en noem de relaties ertussen.
Antwoord in precies deze drie secties, een rij per regel:
<summary>
samenvatting in hooguit twee zinnen
</summary>
<entiteiten>
naam | klasse in het Engels | korte Engelse omschrijving van de klasse
</entiteiten>
<relaties>
naam | relatie | naam
</relaties>

Tekst:
{INPUT_TEXT}
"""

SELECT_SYSTEM = "Je kiest bij een entiteit de schema.org klasse die er het best bij past."
SELECT_HUMAN = """Tekst:
{ORIGINAL_TEXT}

Entiteit: {ENTITY_NAME}
Voorgestelde klasse: {CLASS_NAME} ({DESCRIPTION})

Kandidaten:
{SCHEMA_CANDIDATES}

Geef JSON met reasoning (een zin), selected_class (naam) en selected_number (1-5)."""

TRANSFORM_SYSTEM = "Je schrijft tekst om naar een JSON-LD object met schema.org termen."
TRANSFORM_HUMAN = """Schrijf een geldig JSON-LD object voor de tekst. Gebruik alleen onderstaande definities.

Tekst:
{INPUT_TEXT}

Definities:
{SCHEMA_DEFINITIONS}

Relaties:
{EXTRACTED_RELATIONS}

{RERUN}
"""
RERUN = """De vorige versie is afgekeurd. Verbeter de fouten.

Vorige versie:
{PREVIOUS_JSON_LD}

Fouten:
{VALIDATION_OUTPUT}"""

LABEL_SYSTEM = "Je wijst labels uit een vaste lijst toe aan een tekst."
LABEL_HUMAN = """Kies de labels die bij de tekst passen, alleen uit deze lijsten.

Onderwerp:
{ONDERWERP_LIST}

Beleving:
{BELEVING_LIST}

Tekst:
{INPUT_TEXT}

Geef JSON met onderwerp_labels en beleving_labels; elk heeft minstens een label."""
