"""Schemas of analysis records: what an extractor hands over, one row a document."""

TABLE = "struct<hasHeaders:boolean,headerCount:int,hasScope:boolean,hasRowStructure:boolean,rowCount:int,hasNestedTable:boolean,hasCaption:boolean,hasConsistentColumns:boolean,columnCounts:array<int>,hasHeaderAssociation:boolean>"
PDF = (
    "doc_id long, error string, hasStructTree boolean, hasLang boolean, lang string, hasOutlines boolean, outlineCount int, hasAcroForm boolean, "
    "formFields array<struct<name:string,hasTU:boolean>>, images array<struct<ref:string,hasAlt:boolean,altText:string>>, imageObjectCount int, "
    f"headings array<string>, tables array<{TABLE}>, lists array<struct<isWellFormed:boolean>>, paragraphCount int, totalPageCount int, "
    "fonts array<struct<name:string,embedded:boolean>>, visibleFonts array<string>, accessibilityAllowed boolean, displayDocTitle boolean, "
    "hasXfa boolean, needsRendering boolean, structTreeDepth int, hasContentOrder boolean, pageCount int, hasText boolean, textLength int, "
    "title string, links array<struct<url:string,text:string,tagged:boolean>>, imageCount int, nonArtifactImageCount int"
)
_CONTRAST = "contrast struct<checked:int,unresolved:int,failing:array<struct<ratio:double>>>"
_IMAGES = "images array<struct<altText:string,decorative:boolean>>"
_LINKS = "links array<struct<text:string,resolved:boolean>>"
DOCX = f"doc_id long, documentOk boolean, stylesOk boolean, coreOk boolean, title string, language string, headings array<int>, fakeHeadings int, {_IMAGES}, tables array<struct<hasHeaderRow:boolean,rowCount:int,colCount:int,nested:boolean,layout:boolean>>, {_LINKS}, {_CONTRAST}, realItems int, manualItems int"
PPTX = f"doc_id long, title string, language string, slides array<struct<title:string,hidden:boolean,titleFirst:boolean>>, {_IMAGES}, tables array<struct<hasHeaderRow:boolean,rowCount:int,colCount:int>>, {_LINKS}, {_CONTRAST}, realItems int, manualItems int, hasMedia boolean"
XLSX = f"doc_id long, title string, valuedCells int, sheets array<struct<name:string,hidden:boolean,cells:int,hasTable:boolean,hasPivot:boolean>>, tables array<struct<hasHeaderRow:boolean,columnCount:int>>, {_IMAGES}, {_LINKS}, {_CONTRAST}"
