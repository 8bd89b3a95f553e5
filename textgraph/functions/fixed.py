"""Words, tags and formats that results depend on."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Main topics per signal type; one of them belongs to both.
ONDERWERP = "onderwerp"
BELEVING = "beleving"
SIGNAL_TOPICS = {
    ONDERWERP: [
        "Bouwen en verbouwen",
        "Burgerzaken",
        "Dagelijks leven en sociale gelegenheden",
        "Financiële ondersteuning",
        "Maatschappelijke ondersteuning",
        "No topic found",
        "Opruimen, afval en onderhoud",
        "Parkeren",
        "Veiligheid en omgeving",
        "Vervoer",
        "Werk",
        "Wonenen en ondernemen",
        "Zorg",
    ],
    BELEVING: [
        "Informatievoorziening",
        "Houding & Gedrag medewerker",
        "Fysieke dienstverlening",
        "Digitale mogelijkheden",
        "Contact leggen met medewerker",
        "Algemene ervaring",
        "Afhandeling",
        "Processen",
        "Prijs & Kwaliteit",
        "No topic found",
        "Kennis & Vaardigheden medewerker",
    ],
}
NO_LABEL = "No subtopic found"
NO_TOPIC = "No topic found"

# Taxonomy and dataset columns.
TAXONOMY_COLUMNS = {"Hoofd_klantsignaal": "main_topic", "Sub_klantsignaal": "sub_topic"}
TEXT_COLUMN = "Synthetic Text"
LABELS_COLUMN = "validated_labels"

# Sections of an extraction answer.
SUMMARY_TAG = "summary"
ENTITY_TAG = "entiteiten"
RELATION_TAG = "relaties"

# Texts that stand in for something missing.
NO_DESCRIPTION = "No description available"
NO_RELATIONS = "Geen expliciete relaties gevonden"
NO_VALIDATION_OUTPUT = "Geen validatie output beschikbaar"
SKIPPED_VALIDATION = "Skipped validation due to entity extraction failure"

# Heads of a definition block.
SCHEMA_HEAD = "**Schema: {LABEL}**"
SCHEMA_USERS = "Entiteiten die dit schema gebruiken:"

# Names of the model calls in the call log.
CALL_EXTRACT = "n1_entity_extraction"
CALL_SELECT = "n2_schema_selection_"
CALL_TRANSFORM = "n3_transform_to_kg_run_"
CALL_LABELS = "n5_add_labels"

# Properties whose names need no comment, and the size from which plain text
# properties are listed together.
SELF_EXPLANATORY = [
    "name", "description", "email", "telephone", "url",
    "image", "logo", "identifier", "alternateName",
]
TEXT_LIST_FROM = 6
DEFINITION_FIELDS = ["label", "uri", "subClassOf", "comments", "properties"]

TOP_K = 5
MAX_RUNS = 5
MAX_TRIES = 3
# ----------------------------------------------------------------------------

# The characters that Python's str.strip removes.
SPACE = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
