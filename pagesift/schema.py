"""Row types of the engine, as DDL."""

SPAN = "struct<ord:int,text:string,x:double,y:double,font_size:double,font_name:string>"
TABLE = "struct<num_columns:int,rows:array<array<string>>>"
ELEMENT = f"struct<kind:string,level:int,text:string,table:{TABLE}>"
ERROR = "struct<class:string,message:string,position:bigint,stage:string>"
PAGES = f"doc_id string, page_no int, spans array<{SPAN}>, error {ERROR}"
