"""Issue catalog: code -> (title, severity, text with %s places)."""

from __future__ import annotations

ERROR, WARNING, PASSED, NEW = "Error", "Warning", "Passed", "New"

# Codes, titles, severities and texts that users of the service know.
CATALOG: dict[str, tuple[str, str, str]] = {
    "M003": ("Missing required property", ERROR, '%s Required property "%s" is empty.'),
    "M004": ("Invalid integer value", ERROR, '%s Property "%s": "%s" is not a valid integer type.'),
    "M005": ("Invalid number value", ERROR, '%s Property "%s": "%s" is not a valid number type.'),
    "M007": ("Invalid date value", ERROR, '%s Property "%s": "%s" is not a valid date type.'),
    "M008": ("Invalid boolean value", ERROR, '%s Property "%s": "%s" is not a valid boolean type.'),
    "M009": ("Invalid property definition", ERROR,
             '%s Property "%s": "%s" type is not an allowed property type for this model'),
    "M010": ("Value not permitted", ERROR, '%s "%s" is not a permissible value for property "%s".'),
    "M011": ("Value out of range", ERROR, '%s Property "%s": "%s" is below lower bound.'),
    "M012": ("Value out of range", ERROR, '%s Property "%s": "%s" is above upper bound.'),
    "M013": ("Relationship not specified", ERROR,
             "%s All related node IDs are missing. Please ensure at least one related node ID is included."),
    "M014": ("Related node not found", ERROR, '%s Related node "%s" %s not found.'),
    "M016": ("Duplicate IDs", ERROR, "%s Same ID also appears in %s."),
    "M017": ("Invalid Property", WARNING, '%s Property "%s" is not defined in the model.'),
    "M018": ("Updating existing data", WARNING, '%s "%s": "%s" : already exists and will be updated.'),
    "M019": ("Data not found", ERROR,
             '%s The node to be deleted  "%s": "%s" : does not exist in the Data Commons repository.'),
    "M021": ("Invalid node", ERROR, '%s "nodeType" or "props" is empty.'),
    "M022": ("Missing ID property", ERROR, '%s ID property, "%s" is empty.'),
    "M023": ("Invalid relationship", ERROR, '%s Relationship to a "%s" node is not defined.'),
    "M024": ("One-to-one relationship conflict", ERROR, '%s Associated with multiple "%s" nodes: %s.'),
    "M025": ("Many-to-one relationship conflict", ERROR, '%s Associated with multiple "%s" nodes: %s.'),
    "M026": ("Invalid data model", ERROR, '"properties" is not defined in the model.'),
    "M027": ("CDE not available", ERROR,
             '%s CDE for property "%s" is not available. Please try again later and contact the helpdesk if'
             " this error persists."),
    "M028": ("Program name mismatch", ERROR, "%s %s"),
    "M029": ("Study name mismatch", ERROR,
             "%s Study name mismatch: Study name doesn't match the Data Submission's associated study - '%s'."),
    "M030": ("Unknown program association", ERROR,
             "%s Study '%s' has no program association. Please contact your curator about this issue."),
    "M031": ("Invalid string pattern", ERROR, '%s "%s" does not comply to string pattern for property "%s".'),
    "M032": ("Invalid pattern definition", ERROR,
             '%s Pattern "%s" for property "%s" is not a valid Regular Expression. Please contact your Data'
             " Concierge to resolve this issue."),
    "M033": ("Delete required property", ERROR,
             "%s deleting value of a required property “%s” is not allowed."),
    "M035": ("Invalid record/node type", ERROR, '%s Record/node type "%s" is not defined in the model.'),
    "M036": ("Incompatible consent codes", ERROR,
             "%s A file cannot be both controlled access and open (consent code -1)"),
    "F001": ("Data File not found", ERROR, 'File "%s" not found.'),
    "F002": ("File records not found", ERROR, 'File "%s" not found.'),
    "F003": ("Data file size mismatch", ERROR, 'File "%s": expected size: %s, actual size: %s.'),
    "F004": ("Data file MD5 mismatch", ERROR, 'File "%s": expected MD5: %s, actual MD5: %s.'),
    "F005": ("Duplicated file records detected", WARNING,
             'File "%s": already exists with the same name and md5 value.'),
    "F006": ("Conflict file records detected", WARNING,
             'File "%s": A file with the same name but different md5 value was found.'),
    "F007": ("Duplicated file content detected", WARNING,
             'File "%s": another file with the same MD5 found.'),
    "F008": ("Orphaned file found", ERROR,
             'File "%s": associated metadata not found. Please upload associated metadata (aka. manifest) file.'),
    "F009": ("Invalid dataRecord", ERROR, "Invalid file object, no s3 file info."),
    "F010": ("Invalid data file info", ERROR, "Invalid s3 data file info."),
    "S001": ("Conflict Data found", ERROR, "%s Identical data found in other submissions."),
}
