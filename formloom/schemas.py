"""Row shapes of the central tables, as DDL strings."""

from __future__ import annotations

TABLE_TYPE = (
    "struct<n_rows:int,n_cols:int,headers:array<string>,rows:array<array<string>>,"
    "merged_cells:array<struct<row:int,col:int,rowspan:int,colspan:int>>,"
    "col_widths:array<int>>"
)
IMAGE_TYPE = (
    "struct<relationship_id:string,file_name:string,hash:string,width_emu:bigint,"
    "height_emu:bigint,content_type:string>"
)
NUMBERING_TYPE = "struct<num_id:string,level:int,is_ordered:boolean,list_text:string>"
RUN_TYPE = (
    "struct<text:string,font:string,size:double,bold:boolean,italic:boolean,"
    "underline:boolean,color:string,highlight:string>"
)
FORMATTING_TYPE = (
    "struct<style_name:string,alignment:string,font:string,size:double,bold:boolean,"
    "italic:boolean,underline:boolean,color:string,shading:string,"
    "borders:map<string,string>,margins:map<string,int>>"
)

#: Columns of one element, in canonical order.
ELEMENT_COLUMNS = {
    "doc_order": "int",
    "node_id": "string",
    "parent_node_id": "string",
    "type": "string",
    "subtype": "string",
    "style_name": "string",
    "text": "string",
    "position_index": "int",
    "header_footer_scope": "string",
    "section_index": "int",
    "table_structure": TABLE_TYPE,
    "image_ref": IMAGE_TYPE,
    "numbering_info": NUMBERING_TYPE,
    "runs": f"array<{RUN_TYPE}>",
    "formatting": FORMATTING_TYPE,
    "semantic_hints": "array<string>",
}

ELEMENT_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in ELEMENT_COLUMNS.items()) + ">"

#: One row per document.
DOCUMENT_DDL = (
    f"group_id string, doc_id string, doc_seq bigint, elements array<{ELEMENT_TYPE}>"
)

TABLE_COLUMN_TYPE = (
    "struct<field_name:string,label:string,field_type:string,required:boolean>"
)
PLACEMENT_ROWS_TYPE = "array<map<string,string>>"
USAGE_TYPE = (
    "struct<in:bigint,out:bigint,calls:bigint,cost_usd:double,"
    "by_model:map<string,struct<in:bigint,out:bigint,calls:bigint>>>"
)
