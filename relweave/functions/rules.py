"""Name rules that classify columns.  Everything here is fixed values: results must
name these generators, providers, confidences and parameters, first match first.
"""

# (pattern over the whole lowercase name, generator, provider, confidence, parameters)
NAME_RULES = (
    # personal
    (r"^e?mail(_address)?$", "email", "mimesis", 0.95, {}),
    (r"^first_?name$", "first_name", "mimesis", 0.95, {}),
    (r"^last_?name$", "last_name", "mimesis", 0.95, {}),
    (r"^full_?name$", "full_name", "mimesis", 0.95, {}),
    (r"^username$", "username", "mimesis", 0.95, {}),
    (r"^(user_?)?name$", "username", "mimesis", 0.85, {}),
    (r"^password(_hash)?$", "password", "mimesis", 0.90, {}),
    (r"^avatar(_url)?$", "avatar_url", "mimesis", 0.90, {}),
    (r"^(profile_?)?image(_url)?$", "avatar_url", "mimesis", 0.85, {}),
    (r"^bio(graphy)?$", "text", "mimesis", 0.85, {}),
    (r"^gender$", "gender", "mimesis", 0.90, {}),
    (r"^(date_of_)?birth(day|date)?$", "date_of_birth", "mimesis", 0.90, {}),
    (r"^age$", "age", "builtin", 0.85, {}),
    (r"^ssn$", "ssn", "faker", 0.90, {}),
    (r"^national_?id(_number)?$", "national_id", "faker", 0.80, {}),
    # contact
    (r"^phone(_number)?$", "phone", "mimesis", 0.95, {}),
    (r"^(mobile|cell)(_phone)?(_number)?$", "phone", "mimesis", 0.90, {}),
    (r"^fax(_number)?$", "phone", "mimesis", 0.85, {}),
    (r"^(home|work|office)_?phone$", "phone", "mimesis", 0.85, {}),
    (r"^(web_?)?site(_url)?$", "url", "mimesis", 0.90, {}),
    (r"^website$", "url", "mimesis", 0.90, {}),
    # address
    (r"^address(_line)?(_[12])?$", "address", "mimesis", 0.90, {}),
    (r"^street(_address)?(_line)?$", "street_address", "mimesis", 0.90, {}),
    (r"^city$", "city", "mimesis", 0.95, {}),
    (r"^(state|province|region)(_code)?$", "state", "mimesis", 0.90, {}),
    (r"^(zip|postal)(_code)?$", "zip_code", "mimesis", 0.95, {}),
    (r"^country$", "country", "mimesis", 0.95, {}),
    (r"^country_code$", "country_code", "mimesis", 0.90, {}),
    (r"^lat(itude)?$", "latitude", "mimesis", 0.90, {}),
    (r"^(lon|lng)(gitude)?$", "longitude", "mimesis", 0.90, {}),
    (r"^county$", "city", "mimesis", 0.75, {}),
    (r"^time_?zone$", "timezone", "mimesis", 0.90, {}),
    # temporal
    (r"^created_?(at|on|date|time)?$", "datetime", "mimesis", 0.90, {}),
    (r"^updated_?(at|on|date|time)?$", "datetime", "mimesis", 0.90, {}),
    (r"^deleted_?(at|on|date)?$", "datetime", "mimesis", 0.90, {}),
    (r"^(start|begin)_?(date|time|at)?$", "datetime", "mimesis", 0.85, {}),
    (r"^(end|finish|expire[ds]?)_?(date|time|at)?$", "datetime", "mimesis", 0.85, {}),
    (r"^(published|posted|sent)_?(at|on|date)?$", "datetime", "mimesis", 0.85, {}),
    (r"^(last_)?login_?(at|date|time)?$", "datetime", "mimesis", 0.85, {}),
    (r"^(registered|joined|signup)_?(at|on|date)?$", "datetime", "mimesis", 0.85, {}),
    (r"^(due|delivery|ship)_?(date|at)?$", "datetime", "mimesis", 0.85, {}),
    (r"^timestamp$", "datetime", "mimesis", 0.85, {}),
    # financial
    (r"^price$", "price", "mimesis", 0.95, {}),
    (r"^(unit_)?price$", "price", "mimesis", 0.90, {}),
    (r"^(total_?)?amount$", "price", "mimesis", 0.85, {}),
    (r"^(sub_?)?total$", "price", "mimesis", 0.85, {}),
    (r"^cost$", "price", "mimesis", 0.90, {}),
    (r"^balance$", "price", "mimesis", 0.85, {}),
    (r"^(tax|discount|fee|charge)(_amount)?$", "price", "mimesis", 0.85, {}),
    (r"^currency(_code)?$", "currency_code", "mimesis", 0.90, {}),
    (r"^credit_card(_number)?$", "credit_card", "mimesis", 0.90, {}),
    (r"^(card_?)?cvv$", "cvv", "builtin", 0.85, {}),
    (r"^(card_?)?expir(y|ation)(_date)?$", "credit_card_expiry", "mimesis", 0.85, {}),
    # content
    (r"^title$", "title", "mimesis", 0.90, {}),
    (r"^(sub_?)?title$", "title", "mimesis", 0.85, {}),
    (r"^description$", "text", "mimesis", 0.85, {}),
    (r"^(body|content|message|comment|note|summary|excerpt)$", "text", "mimesis", 0.85, {}),
    (r"^slug$", "slug", "mimesis", 0.90, {}),
    (r"^(url|link|href)$", "url", "mimesis", 0.90, {}),
    (r"^(image|photo|picture|thumbnail)(_url)?$", "image_url", "mimesis", 0.90, {}),
    (r"^file_?(path|name)$", "filename", "mimesis", 0.80, {}),
    (r"^mime_?type$", "mime_type", "builtin", 0.75, {}),
    (r"^file_?size$", "random_int", "builtin", 0.70, {}),
    (r"^tags?$", "word", "mimesis", 0.75, {}),
    (r"^label$", "word", "mimesis", 0.75, {}),
    (r"^color(_code)?$", "hex_color", "mimesis", 0.85, {}),
    # identifiers
    (r"^uuid$", "uuid4", "builtin", 0.95, {}),
    (r"^(sku|product_code|item_code)$", "sku", "builtin", 0.85, {}),
    (r"^(ref(erence)?|tracking)(_number|_code|_id)?$", "reference_code", "builtin", 0.80, {}),
    (r"^token$", "token", "builtin", 0.80, {}),
    (r"^api_?key$", "token", "builtin", 0.80, {}),
    (r"^(hash|checksum|digest)$", "hash", "builtin", 0.80, {}),
    (r"^ip_?address$", "ip_address", "mimesis", 0.80, {}),
    (r"^ip(v[46])?$", "ip_address", "mimesis", 0.85, {}),
    (r"^mac_?address$", "mac_address", "mimesis", 0.85, {}),
    (r"^user_?agent$", "user_agent", "mimesis", 0.85, {}),
    # status
    (r"^status$", "status", "builtin", 0.85, {}),
    (r"^(type|kind|category)$", "category", "builtin", 0.80, {}),
    (r"^role$", "role", "builtin", 0.85, {}),
    (r"^(priority|severity|level)$", "priority", "builtin", 0.80, {}),
    (r"^is_?(active|enabled|verified|public|admin|deleted|archived|featured)$", "random_bool", "builtin", 0.90, {}),
    (r"^(has|can|should|allow)_\w+$", "random_bool", "builtin", 0.80, {}),
    (r"^(locale|language|lang)(_code)?$", "locale", "mimesis", 0.85, {}),
    # quantity
    (r"^(quantity|qty|count|num(ber)?)$", "random_int", "builtin", 0.85, {"min": "1", "max": "100"}),
    (r"^(weight|height|width|length|depth|distance)$", "random_float", "builtin", 0.80, {}),
    (r"^(rating|score|rank)$", "random_int", "builtin", 0.85, {"min": "1", "max": "5"}),
    (r"^(percent|percentage|ratio)$", "random_float", "builtin", 0.80, {"min": "0.0", "max": "100.0"}),
    (r"^(version|revision)$", "version", "builtin", 0.80, {}),
    (r"^sort_?order$", "random_int", "builtin", 0.75, {"min": "0", "max": "1000"}),
)

# data type -> generator where no name rule matches (confidence 0.5, provider builtin)
TYPE_FALLBACKS = {
    "integer": "random_int", "bigint": "random_int", "smallint": "random_int",
    "float": "random_float", "decimal": "random_decimal", "boolean": "random_bool",
    "varchar": "random_string", "text": "random_text", "date": "random_date",
    "datetime": "random_datetime", "timestamp": "random_datetime", "time": "random_time",
    "uuid": "uuid4", "json": "random_json", "binary": "random_bytes",
    "enum": "random_choice", "array": "random_list", "unknown": "random_string",
}

# case-insensitive, found anywhere in the name
PII_PATTERNS = (
    r"social_security", r"credit_card", r"card_number", r"date_of_birth", r"bank_account",
    r"routing_number", r"national_id", r"drivers_license", r"medical_record",
    r"email_address", r"zip_code", r"postal_code",
    r"(?:^|_)passport(?:$|_)", r"(?:^|_)phone(?:$|_)", r"(?:^|_)mobile(?:$|_)",
    r"(?:^|_)salary(?:$|_)", r"(?:^|_)income(?:$|_)", r"(?:^|_)address(?:$|_)",
    r"(?:^|_)email(?:$|_)", r"(?:^|_)tax_id(?:$|_)",
    r"\bssn\b", r"\bdob\b", r"\bcvv\b",
)
